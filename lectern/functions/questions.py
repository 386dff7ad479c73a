"""Column functions that read a user's question: intent, flags, terms, route, rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import EMPTY_STRINGS, collapse_ws, left, ordered_distinct, strip

# Phrases and word lists.
CHITCHAT = (
    "hi", "hello", "hey", "thanks", "thank you", "ok", "okay", "cool", "great", "nice", "bye", "goodbye",
)
CHITCHAT_PATTERN = r"\A(hi|hello|hey|thanks|thank you|ok|okay|bye|goodbye)[!. ]*\z"
SUMMARY_EXACT = ("brief", "summary", "summarize", "tldr", "tl;dr")
SUMMARY_PARTS = ("summarize", "summary", "tl;dr", "tldr")
COMPARE_EXACT = ("compare", "comparison", "diff")
EXTRACT_PARTS = ("extract", "quote", "list all", "pull out", "give me all")
EXPLAIN_PARTS = ("explain", "why", "how does", "walk me through")
LOOKUP_PARTS = ("find", "where", "which", "what", "who", "when", "show", "?")
ANCHORS = (
    "document", "documents", "doc", "docs", "file", "files", "attached", "provided", "from the text",
    "from the document", "from the file", "in the document", "in this file", "section", "page", "table",
    "figure", "selection", "excerpt", "source", "sources",
)
DEICTIC = r"\b(this|that|these|those|it|them|both)\b"
DEICTIC_VERBS = ("summarize", "summary", "explain", "compare", "what is", "what's", "tell me about")
GENERIC = (
    "explain", "summarize", "summary", "overview", "describe", "tell me more", "help me understand",
    "explain this", "summarize this", "describe this", "what is this", "what's this",
)
RELEVANCE_STOP = (
    "the", "and", "for", "with", "that", "this", "from", "into", "have", "has", "had", "are", "was", "were",
    "will", "would", "could", "should", "what", "which", "who", "when", "where", "why", "how", "show", "find",
    "give", "tell", "about", "document", "documents", "file", "files",
)
SCAN_STOP = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "from", "this", "that", "these",
    "those", "is", "are", "was", "were", "be", "been", "it", "as", "at", "by", "about", "into", "what", "why",
    "how", "when", "where", "which", "can", "could", "should", "would",
)
QUOTED = "\"([^\"]{2,80})\"|'([^']{2,80})'"
ID_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_-]{3,80}"
KEYWORD = r"[A-Za-z][A-Za-z]{4,80}"
RELEVANCE_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_-]{2,80}"
INDEX_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_-]{1,80}"

TASKS = {
    "compare": "Compare the main ideas, similarities, and differences across the provided document(s).",
    "summarize": "Summarize the main ideas and important points in the provided document(s).",
    "explain": "Explain the main ideas and important points in the provided document(s).",
    "extract": "Extract only the specific facts requested by the user from the provided document(s).",
}
TASK_DEFAULT = "Answer the user's request using the provided document evidence."
TASK_SELECTION = "Prioritize the selected excerpt when it is relevant."
TASK_GENERIC = "Start with a concise overview, then provide key supporting details."
TASK_CHAT = "Respond conversationally to the user's request."
TASK_CHAT_EMPTY = "Respond conversationally to the user."
GOALS = {
    "compare": "compare main ideas similarities differences key points",
    "summarize": "summary main ideas important points key details",
    "explain": "explain main ideas important points key details",
    "extract": "extract specific requested facts exact details",
}
GOAL_DEFAULT = "relevant sections key facts important points"
EMPTY_QUERY = "document overview"
SELECTION_QUERY_CHARS = 1400


def _plain(col: Column) -> Column:
    return F.lower(strip(F.coalesce(col, F.lit(""))))


def _has_any(col: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | col.contains(part)
    return found


def _matches(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), group)


def is_chitchat(col: Column) -> Column:
    q = strip(collapse_ws(_plain(col)))
    return (q == "") | q.isin(*CHITCHAT) | q.rlike(CHITCHAT_PATTERN)


def is_summary_request(col: Column) -> Column:
    q = _plain(col)
    return q.isin(*SUMMARY_EXACT) | _has_any(q, SUMMARY_PARTS)


def is_compare_request(col: Column) -> Column:
    q = F.regexp_replace(strip(collapse_ws(_plain(col))), r"^[.!?;:]+|[.!?;:]+$", "")
    few_words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) <= 3
    return q.isin(*COMPARE_EXACT) | (q.startswith("compare ") & few_words)


def is_doc_anchored(col: Column) -> Column:
    q = _plain(col)
    deictic = q.rlike(DEICTIC) & _has_any(q, DEICTIC_VERBS)
    return (q != "") & (_has_any(q, ANCHORS) | deictic)


def intent(col: Column) -> Column:
    q = _plain(col)
    return (
        F.when(is_chitchat(q), "chat")
        .when(is_compare_request(q), "compare")
        .when(is_summary_request(q), "summarize")
        .when(_has_any(q, EXTRACT_PARTS), "extract")
        .when(_has_any(q, EXPLAIN_PARTS), "explain")
        .when(_has_any(q, LOOKUP_PARTS), "lookup")
        .otherwise("chat")
    )


def is_generic_request(col: Column, intent_col: Column) -> Column:
    q = collapse_ws(_plain(col))
    few = F.size(_matches(q, r"[a-z0-9']+")) <= 2
    return (q == "") | q.isin(*GENERIC) | (intent_col.isin("summarize", "explain") & few)


def route(
    raw_large: Column,
    small_doc: Column,
    has_selection: Column,
    has_turn_docs: Column,
    has_scope: Column,
    intent_col: Column,
    anchored: Column,
    generic: Column,
) -> Column:
    asks_docs = anchored | has_turn_docs | generic
    return (
        F.when(raw_large, "raw_large")
        .when(small_doc & ~has_selection, "small_doc")
        .when(has_selection, "selection_rag")
        .when(has_scope & (intent_col == "compare"), "rag")
        .when(has_scope & asks_docs & intent_col.isin("lookup", "extract", "summarize", "explain"), "rag")
        .otherwise("chat")
    )


def _by_intent(intent_col: Column, table: dict[str, str], default: str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, text in table.items():
        out = out.when(intent_col == name, F.lit(text))
    return out.otherwise(F.lit(default))


def retrieval_query(
    text: Column, intent_col: Column, has_scope: Column, selection: Column, focus_name: Column
) -> Column:
    asked = strip(F.coalesce(text, F.lit("")))
    q = F.when(asked == "", F.lit(EMPTY_QUERY)).otherwise(asked)
    selected = strip(F.coalesce(selection, F.lit("")))
    has_selection = selected != ""
    goal = _by_intent(intent_col, GOALS, GOAL_DEFAULT)
    body = F.when(
        is_generic_request(q, intent_col), F.concat(goal, F.lit("\nUser request: "), q)
    ).otherwise(q)
    focus = F.when(F.coalesce(focus_name, F.lit("")) != "", F.concat(F.lit("Focus file: "), focus_name))
    picked = F.when(
        has_selection, F.concat(F.lit("Selection focus:\n"), left(selected, SELECTION_QUERY_CHARS))
    )
    return F.when(~has_scope & ~has_selection, q).otherwise(strip(F.concat_ws("\n", body, focus, picked)))


def task_instruction(
    text: Column, intent_col: Column, route_col: Column, has_scope: Column, has_selection: Column
) -> Column:
    q = strip(F.coalesce(text, F.lit("")))
    request = F.when(q != "", F.concat(F.lit("User request: "), q))
    chat = F.when(q != "", F.concat_ws("\n", F.lit(TASK_CHAT), request)).otherwise(F.lit(TASK_CHAT_EMPTY))
    lines = F.concat_ws(
        "\n",
        _by_intent(intent_col, TASKS, TASK_DEFAULT),
        F.when(has_selection, F.lit(TASK_SELECTION)),
        F.when(is_generic_request(q, intent_col), F.lit(TASK_GENERIC)),
        request,
    )
    return F.when((route_col == "chat") | ~has_scope, chat).otherwise(lines)


def relevance_terms(col: Column, limit: int = 12) -> Column:
    tokens = F.transform(_matches(col, RELEVANCE_TOKEN), F.lower)
    kept = F.filter(tokens, lambda t: ~t.isin(*RELEVANCE_STOP))
    return F.slice(F.array_distinct(kept), 1, limit)


def quoted_phrases(col: Column) -> Column:
    hits = _matches(col, QUOTED)
    return F.filter(
        F.transform(hits, lambda h: strip(F.substr(h, F.lit(2), F.length(h) - 2))), lambda t: t != ""
    )


def id_tokens(col: Column) -> Column:
    return F.filter(_matches(col, ID_TOKEN), lambda t: t.rlike(r"[0-9_-]"))


def keywords(col: Column) -> Column:
    return F.filter(_matches(col, KEYWORD), lambda t: ~F.lower(t).isin(*SCAN_STOP))


def scan_term_sets(col: Column, limit: int = 8) -> Column:
    """Struct of phrases, ids, keywords and their ordered union cut to the limit."""
    phrases = ordered_distinct(quoted_phrases(col))
    ids = ordered_distinct(id_tokens(col))
    keys = ordered_distinct(keywords(col))
    every = F.slice(F.array_distinct(F.concat(phrases, ids, keys)), 1, limit)
    return F.struct(
        phrases.alias("phrases"), ids.alias("ids"), keys.alias("keywords"), every.alias("terms")
    )


def scan_terms(col: Column, limit: int = 8) -> Column:
    return scan_term_sets(col, limit)["terms"]


def exact_terms(col: Column, limit: int = 8) -> Column:
    """Quoted phrases, topped up with id-like tokens to the limit, then repeats dropped."""
    phrases = quoted_phrases(col)
    return F.array_distinct(F.slice(F.concat(phrases, id_tokens(col)), 1, limit))


def index_terms(col: Column, limit: int = 8) -> Column:
    """First tokens of a keyword query, lower-cased; repeats stay."""
    return F.slice(F.transform(_matches(col, INDEX_TOKEN), F.lower), 1, limit)


def empty_terms() -> Column:
    return F.array().cast(EMPTY_STRINGS)
