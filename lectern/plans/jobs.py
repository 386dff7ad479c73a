"""End-to-end jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import codes, questions
from lectern.functions.text import chunk_id, is_blank, normalize_text, strip
from lectern.operators import evidence, find, joins, reports, scan, trees, windows
from lectern.operators.blocks import blocks_from_text, text_blocks
from lectern.operators.chunking import chunk_documents, with_chunk_context
from lectern.operators.dense import vector_topk
from lectern.operators.embedding import embed, hashed_bag
from lectern.operators.filters import classify_file_size, relevance_gate, resolve_scope, scope_filter
from lectern.operators.file_search import long_files, search_files
from lectern.operators.hybrid import hybrid_topk, search
from lectern.operators.keyword import bm25_topk, build_term_index, keyword_scan_topk
from lectern.operators.maintenance import apply_updates, plan_retries
from lectern.session import settle
from lectern.sources.files import default_registry, detect_mime, extract
from lectern.sources.tables import split_by_dimension

MODEL, VERSION = "hashed-bag", 1
#: Up to here paths are broadcast to the files' bytes (about 300 bytes each).
BROADCAST_PATHS = 50_000


def with_bytes(narrow: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``narrow`` (path, created_at, …) with their bytes. Few paths are brought to the bytes, in the task that
    reads them; only more than ``BROADCAST_PATHS`` of them take a shuffle."""
    keys = ["path", "created_at"]
    wanted = F.broadcast(narrow) if narrow.count() <= BROADCAST_PATHS else narrow
    return files.select(*keys, "content").join(wanted, keys)


def ingest(
    files: DataFrame, factory: Callable | None = None, registry: dict | None = None, model: str = MODEL,
    version: int = VERSION, now_s: int = 0, known: DataFrame | None = None, known_links: DataFrame | None = None,
    dims: DataFrame | None = None, sizes: dict | None = None,
) -> dict[str, DataFrame]:
    """Files with bytes to tables: files, links, file_text, chunks, vectors, raw_large, failures.

    ``files``: path, filename, size_bytes, created_at, content, chat_id; a path names one file at a time. Equal bytes are
    read once, and not at all where ``known`` (file_id) has them; ``known_links`` (chat_id, file_id) are not made again.
    Bytes are hashed where they are scanned; what is grouped and joined from there on is their hash. A file that is
    refused or cannot be read, or whose vectors do not have the dimension that ``dims`` expects of the model's version,
    becomes a failure row. ``sizes`` holds other limits than those of ``classify_file_size``.
    """
    ident = files.withColumn("hash", F.sha2("content", 256)).drop("content").withColumn("file_id", F.concat(F.lit("file_"), F.col("hash")))
    ident = settle(ident, "identities")
    links = ident.groupBy("chat_id", "file_id").agg(F.min("created_at").alias("created_at"))
    if known_links is not None:
        links = links.join(known_links.select("chat_id", "file_id"), ["chat_id", "file_id"], "left_anti")
    rest = [c for c in ident.columns if c not in ("file_id", "hash")]
    once = ident.groupBy("file_id", "hash").agg(F.min_by(F.struct(*rest), F.struct("created_at", "path")).alias("_first")).select("file_id", "hash", "_first.*")
    if known is not None:
        # the new hashes go to the registry, however large it is, and come back as the few that it holds
        once = settle(once, "once")
        asked = once.select("file_id")
        held = known.select("file_id").join(F.broadcast(asked) if asked.count() <= BROADCAST_PATHS else asked, "file_id", "left_semi").distinct()
        once = once.join(held, "file_id", "left_anti")
    routed = settle(classify_file_size(detect_mime(once, "filename"), **(sizes or {})), "routed")
    taken = routed.filter("policy = 'ingest'")
    read_now = with_bytes(taken.select("path", "created_at", "file_id", "mime"), files)
    texts = settle(extract(read_now.select("file_id", "mime", "content"), registry or default_registry()), "texts")
    read = texts.filter(F.col("error").isNull()).select("file_id", normalize_text(F.col("text")).alias("plain_text"))
    with_blocks = text_blocks(read, "plain_text")
    owners = taken.select(
        "file_id", F.lit(None).cast("string").alias("user_id"), "chat_id", F.lit("upload").alias("source"),
        F.array().cast("array<string>").alias("tags"), "created_at",
    )
    chunks = with_chunk_context(chunk_documents(with_blocks, "file_id", "plain_text", "blocks"), owners).withColumns(
        {"embedding_model": F.lit(model), "embedding_version": F.lit(version)}
    )
    chunks = settle(chunks, "chunks")
    usable = chunks.filter(~is_blank(F.col("text")))
    vectors = embed(usable, "text", factory or hashed_bag()).drop("text").withColumn("embedding_id", F.col("chunk_id"))
    misfits = None
    if dims is not None:
        vectors, misfits = split_by_dimension(settle(vectors, "vectors"), dims)
    bad_read = texts.filter(F.col("error").isNotNull()).select(
        "file_id", F.regexp_extract("error", r"^(\w+)", 1).alias("exception_name"), F.col("error").alias("error_message")
    )
    refused = routed.filter("policy = 'rejected'").select(
        "file_id", F.lit("Rejected").alias("exception_name"), F.col("reject_reason").alias("error_message")
    )
    failed_now = bad_read.unionByName(refused)
    if misfits is not None:
        odd = misfits.groupBy("file_id").agg(F.min("error").alias("error_message"))
        failed_now = failed_now.unionByName(odd.select("file_id", F.lit("DimensionMismatch").alias("exception_name"), "error_message"))
    failures = plan_retries(failed_now.withColumn("retry_count", F.lit(0)), now_s, jitter=0.0)
    rows = apply_updates(routed.drop("reject_reason").withColumn("status", F.lit("completed")), failures.select("file_id", F.lit("failed").alias("status")), ["file_id"])
    large = with_bytes(routed.filter("policy = 'raw_large'").select("path", "created_at", "file_id", "filename"), files)
    return {
        "files": rows, "links": links, "file_text": with_blocks, "chunks": chunks, "vectors": vectors,
        "raw_large": large.select("file_id", "filename", "content"), "failures": failures,
    }


def ingest_documents(docs: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """Chunks of documents that already are text: normalise, block, chunk; no shuffle."""
    clean = docs.select(key, normalize_text(F.col(text)).alias("plain_text"))
    return chunk_documents(text_blocks(clean, "plain_text"), key, "plain_text", "blocks")


def plan_turns(turns: DataFrame, chat_files: DataFrame, files: DataFrame, small: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(turn plans, turn files): intent, scope, route, rewritten query, depth, radius, budgets.

    ``turns``: query_id, chat_id, text, turn_doc_ids, focus_document_id, doc_pane_open, selection_text,
    selection_file_id, capacity, used. ``files``: file_id, filename, policy. ``small`` (query_id) names the turns whose
    document fits whole.
    """
    plan, members = resolve_scope(turns, chat_files)
    names = files.select(F.col("file_id").alias("focus"), F.col("filename").alias("focus_name"))
    raw = chat_files.join(files.filter("policy = 'raw_large'").select("file_id"), "file_id", "left_semi").groupBy("chat_id").agg(
        F.lit(True).alias("_raw")
    )
    text = F.col("text")
    rows = turns.join(plan.drop("chat_id", "doc_pane_open"), "query_id").join(names, "focus", "left").join(raw, "chat_id", "left")
    if small is None:
        rows = rows.withColumn("_small", F.lit(False))
    else:
        rows = rows.join(small.select("query_id").distinct().withColumn("_small", F.lit(True)), "query_id", "left")
    rows = (
        rows
        .withColumn("intent", questions.intent(text))
        .withColumn("generic", questions.is_generic_request(text, F.col("intent")))
        .withColumn("has_selection", ~is_blank(F.col("selection_text")))
        .withColumn("summary", questions.is_summary_request(text))
    )
    anchored = F.col("has_selection") | F.col("summary") | questions.is_doc_anchored(text)
    route = questions.route(
        F.coalesce("_raw", F.lit(False)), F.coalesce("_small", F.lit(False)), F.col("has_selection"),
        F.size(F.coalesce("turn_doc_ids", F.array().cast("array<string>"))) > 0, F.col("has_doc_scope"), F.col("intent"),
        anchored, F.col("generic"),
    )
    rows = rows.withColumn("route", route).withColumn(
        "retrieval_query",
        questions.retrieval_query(text, F.col("intent"), F.col("has_doc_scope"), F.col("selection_text"), F.col("focus_name")),
    )
    scoped = members.filter("role = 'scope'").select("query_id", "file_id", "pos")
    focused = plan.filter("scope = 'focused' and focus is not null").select(
        "query_id", F.col("focus").alias("file_id"), F.lit(0).cast("bigint").alias("pos")
    )
    turn_files = scoped.unionByName(focused)
    counts = turn_files.groupBy("query_id").agg(F.count("*").alias("n_files"))
    rows = rows.join(counts, "query_id", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)).cast("int"))
    budget = F.when(F.col("n_files") > 0, codes.input_budget(F.col("capacity"), F.col("used"))).otherwise(0)
    base = codes.base_depth(F.col("summary"), F.col("has_selection"))
    rows = rows.withColumn("budget", budget.cast("bigint")).withColumn(
        "depth", codes.retrieval_depth(F.col("budget"), F.col("n_files"), base)
    ).withColumn("radius", codes.window_radius(F.col("budget"))).withColumn("base_depth", base)
    return rows.drop("_raw", "_small"), turn_files


def hybrid_per_file(
    asked: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int, embed_query: Callable[[DataFrame], DataFrame],
    sparse: str = "scan",
) -> DataFrame:
    """Fused hits of every (query, file) pair: each file is searched on its own.

    ``asked``: query_id, file_id, text, and where they are there leg (int, at most k), how deep each pair's legs go, and top,
    radius and cap as in ``search_files``; hits that were not made into windows have none there. Queries are embedded once, before they meet their files. Only very long files, and the
    index of ``sparse="bm25"``, take joins of pairs and chunks.
    """
    if sparse != "bm25":
        long = long_files(chunks, vectors)
        if long.isEmpty():
            return search_files(asked, chunks, vectors, k, embed_query)
        short = [df.join(long, "file_id", "left_anti") for df in (asked, chunks, vectors)]
        rest = [df.join(long, "file_id", "left_semi") for df in (asked, chunks, vectors)]
        return search_files(*short, k, embed_query).unionByName(_hybrid_by_joins(*rest, k, embed_query, sparse), allowMissingColumns=True)
    return _hybrid_by_joins(asked, chunks, vectors, k, embed_query, sparse)


def _hybrid_by_joins(
    asked: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int, embed_query: Callable[[DataFrame], DataFrame], sparse: str,
) -> DataFrame:
    once = embed_query(asked.select("query_id", "text").dropDuplicates(["query_id"])).select("query_id", "vector")
    pair = F.concat_ws("\u0001", F.col("query_id").cast("string"), F.col("file_id"))
    pairs = asked.withColumn("_pair", pair)
    dense_q = pairs.join(once, "query_id").select(F.col("_pair").alias("query_id"), "file_id", "vector")
    dense = vector_topk(dense_q, vectors.select("file_id", "chunk_id", "vector"), k, scope=["file_id"])
    sparse_q = pairs.select(F.col("_pair").alias("query_id"), "file_id", "text")
    if sparse == "bm25":
        # terms are scored over the whole index, then kept to the pair's own file before the limit
        leg = bm25_topk(sparse_q, build_term_index(chunks), k, scope=["file_id"])
    else:
        leg = keyword_scan_topk(sparse_q, chunks, k, scope=["file_id"], order="seq")
    if "leg" in asked.columns:
        deep = pairs.select(F.col("_pair").alias("query_id"), "leg")
        dense, leg = (hits.join(deep, "query_id").filter(F.col("rank") <= F.col("leg")) for hits in (dense, leg))
        sparse_q = sparse_q.join(deep, "query_id").withColumnRenamed("leg", "k")
    else:
        sparse_q = sparse_q.withColumn("k", F.lit(k))
    fused = hybrid_topk(
        dense.select("query_id", "chunk_id", "rank"), leg.select("query_id", "chunk_id", "rank"), sparse_q, chunks, "k",
    )
    back = pairs.select("_pair", F.col("query_id").alias("_query"))
    return fused.join(back, F.col("query_id") == F.col("_pair")).select(
        F.col("_query").alias("query_id"), "file_id", "chunk_id", "seq", "score", "rank"
    )


def retrieve(
    turns: DataFrame, chat_files: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame,
    embed_query: Callable[[DataFrame], DataFrame] = embed, max_depth: int = codes.MAX_DEPTH, sparse: str = "scan",
) -> tuple[DataFrame, DataFrame]:
    """(plans, evidence): evidence rows of every document question, within budget and gated."""
    plan, turn_files = plan_turns(turns, chat_files, files)
    plan, turn_files = settle(plan, "turns"), settle(turn_files, "turn-files")
    return plan, retrieve_planned(plan, turn_files, files, chunks, vectors, embed_query, max_depth, sparse)


#: What the evidence of a turn depends on, beside the tables: where it looks, what it asks and how much it may show.
SEARCH_KEYS = (
    "chat_id", "turn_doc_ids", "scope", "focus", "doc_pane_open", "route", "intent", "retrieval_query", "has_selection",
    "depth", "base_depth", "radius", "budget", "n_files")


def same_searches(plan: DataFrame) -> DataFrame:
    """(query_id, asker) of the turns that search: turns that ask the same of the same files share the smallest query_id."""
    picked = strip(F.coalesce("selection_text", F.lit("")))
    asks = plan.filter(F.col("route").isin("rag", "selection_rag")).select("query_id", F.struct(*SEARCH_KEYS, picked.alias("picked")).alias("_ask"))
    first = asks.groupBy("_ask").agg(F.min("query_id").alias("asker"))
    return asks.join(first.withColumnRenamed("_ask", "_same"), F.col("_ask").eqNullSafe(F.col("_same"))).select("query_id", "asker")


def repair_empty(
    pairs: DataFrame, fused: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int, embed_query: Callable[[DataFrame], DataFrame],
    sparse: str,
) -> DataFrame:
    """``fused``, and the hits of the (query, file) pairs that had none, once chunks missing from the index are embedded."""
    empty = settle(pairs.join(fused.select("query_id", "file_id"), ["query_id", "file_id"], "left_anti"), "no-anchors")
    bare = empty.select("file_id").distinct()
    lost = chunks.join(bare, "file_id", "left_semi").join(vectors.select("chunk_id"), "chunk_id", "left_anti")
    lost = lost.filter(~is_blank(F.col("text"))).select("file_id", "chunk_id", "text")
    if empty.isEmpty() or lost.isEmpty():
        return fused
    found = settle(embed_query(lost).select("file_id", "chunk_id", "vector"), "repaired")
    mended = empty.join(found.select("file_id").distinct(), "file_id", "left_semi")
    here = chunks.join(found.select("file_id").distinct(), "file_id", "left_semi")
    return fused.unionByName(hybrid_per_file(mended, here, found, k, embed_query, sparse), allowMissingColumns=True)


def retrieve_planned(
    plan: DataFrame, turn_files: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame,
    embed_query: Callable[[DataFrame], DataFrame] = embed, max_depth: int = codes.MAX_DEPTH, sparse: str = "scan",
) -> DataFrame:
    """Evidence of the turns that search: windows around the hits of each file, the selection's hits, within budget and
    gated. A file without any hit has its missing vectors made and is searched again. ``plan`` and ``turn_files`` are stored
    tables. Turns that ask the same of the same files are searched once."""
    shared = settle(same_searches(plan), "searches")
    askers = shared.select(F.col("asker").alias("query_id")).distinct()
    plan, turn_files = plan.join(askers, "query_id", "left_semi"), turn_files.join(askers, "query_id", "left_semi")
    asked = plan.join(turn_files, "query_id")
    depth = F.greatest(F.col("depth"), F.lit(12))
    per_file = F.when(F.col("scope") == "all", F.ceil(F.greatest(F.lit(codes.DEPTH_ALL), F.col("depth") * F.col("n_files")) / F.col("n_files"))).otherwise(F.col("depth"))
    pairs = asked.select(
        "query_id", "file_id", F.col("retrieval_query").alias("text"), "budget", "radius", "scope", F.least(depth, F.lit(max_depth)).cast("int").alias("leg"),
        per_file.cast("int").alias("top"), codes.file_cap(F.greatest(F.lit(600), F.col("budget")), F.col("n_files")).alias("cap"))
    fused = settle(hybrid_per_file(pairs, chunks, vectors, max_depth, embed_query, sparse), "fused")
    fused = repair_empty(pairs, fused, chunks, vectors, max_depth, embed_query, sparse)
    spans = None
    if "windows" in fused.columns:
        placed = fused.filter(F.col("windows").isNotNull()).select("query_id", "file_id", F.inline("windows"))
        spans, fused = windows.placed_windows(placed, chunks), fused.filter(F.col("windows").isNull())
    if spans is None or not fused.isEmpty():
        anchors = fused.select("query_id", "file_id", "chunk_id", "seq", "score", "rank").join(pairs, ["query_id", "file_id"]).filter(F.col("rank") <= F.col("top"))
        joined = windows.budgeted_windows(anchors, chunks, F.col("radius"), "cap")
        spans = joined if spans is None else spans.unionByName(joined)
    names = files.select("file_id", "filename")
    # of a file among several at most its share of the budget is shown, so no more of a window's text goes on
    several = turn_files.groupBy("query_id").agg(F.count_distinct("file_id").alias("_n")).filter("_n >= 2")
    share = F.greatest(F.lit(evidence.FILE_FLOOR_CHARS).cast("bigint"), F.floor(F.col("budget").cast("bigint") * 4 / F.col("_n"))).cast("int")
    most = plan.filter("scope = 'all'").join(several, "query_id").select("query_id", share.alias("_share"))
    shown = F.when(F.col("_share").isNull(), F.col("text")).otherwise(F.substr("text", F.lit(1), F.col("_share")))
    spans = settle(spans.join(most, "query_id", "left").withColumn("text", shown).drop("_share"), "windows")
    hits = windows.windows_to_hits(spans, names).drop("window_no")
    cols = ["query_id", "doc_id", "chunk_id", "text", "filename", "page", "page_start", "page_end", "score"]
    order = turn_files.select("query_id", F.col("file_id").alias("doc_id"), F.col("pos").alias("file_pos"))
    staged = hits.select(*cols, F.lit(0).alias("_stage"), F.coalesce("page_start", F.lit(0)).alias("_o"))
    if not plan.filter("scope = 'focused'").isEmpty():
        fill_q = pairs.filter("scope = 'focused'").select("query_id", "file_id", "budget")
        fill = windows.coverage_fill(fill_q, spans, chunks).join(names.withColumnRenamed("file_id", "doc_id"), "doc_id", "left")
        staged = staged.unionByName(fill.select(*cols, F.lit(1).alias("_stage"), F.col("seq").alias("_o")))
    if not plan.filter("has_selection").isEmpty():
        picked = selection_hits(plan, turn_files, chunks, vectors, names, embed_query)
        staged = staged.unionByName(picked.select(*cols, F.lit(2).alias("_stage"), F.col("rank").alias("_o")))
    staged = staged.join(order, ["query_id", "doc_id"], "left")
    from pyspark.sql import Window as W

    spot = W.partitionBy("query_id").orderBy("_stage", "file_pos", "_o", "chunk_id")
    listed = staged.withColumn("pos", F.row_number().over(spot)).select(*cols, "pos")
    unique = settle(evidence.dedup_hits(listed), "evidence")
    all_scope = plan.filter("scope = 'all'")
    total = F.greatest(F.lit(codes.DEPTH_ALL), F.col("base_depth") * F.greatest(F.col("n_files"), F.lit(1)))
    mixed = evidence.round_robin(
        unique.join(all_scope.select("query_id", total.alias("_total")), "query_id"), F.col("_total")
    ).drop("_total").withColumn("pos", F.col("mix_pos")).drop("mix_pos")
    fair = evidence.budget_trim_balanced(mixed, all_scope.select("query_id", "budget"), order).drop("file_pos")
    single = evidence.budget_trim(
        unique.join(all_scope.select("query_id"), "query_id", "left_anti"),
        plan.filter("scope = 'focused'").select("query_id", "budget"),
    )
    cut = settle(fair.select(*cols, "pos").unionByName(single.select(*cols, "pos")), "trimmed")
    gate_text = F.concat_ws("\n", "retrieval_query", F.when(F.col("route") == "selection_rag", F.substr(strip(F.col("selection_text")), F.lit(1), F.lit(1800))))
    gated = relevance_gate(cut, plan.select("query_id", questions.relevance_terms(gate_text).alias("terms"), "intent", "scope"))
    return gated.withColumnRenamed("query_id", "asker").join(shared, "asker").select("query_id", *gated.columns[1:])


def selection_hits(
    searched: DataFrame, turn_files: DataFrame, chunks: DataFrame, vectors: DataFrame, names: DataFrame,
    embed_query: Callable[[DataFrame], DataFrame] = embed,
) -> DataFrame:
    """Dense hits for the selected excerpt, max(base depth, 6) deep over the turn's files."""
    picked = searched.filter("has_selection").select("query_id", strip(F.col("selection_text")).alias("text"), F.greatest("base_depth", F.lit(6)).alias("_k"))
    asked = embed_query(picked).join(turn_files.select("query_id", "file_id"), "query_id")
    pair = F.concat_ws("\u0001", F.col("query_id").cast("string"), F.col("file_id"))
    q = asked.select(pair.alias("query_id"), "file_id", "vector")
    found = vector_topk(q, vectors.select("file_id", "chunk_id", "vector"), codes.MAX_DEPTH, scope=["file_id"])
    back = asked.select(pair.alias("_pair"), F.col("query_id").alias("_query"), "_k")
    from lectern.operators.ranking import top_per_group

    rows = found.join(back, F.col("query_id") == F.col("_pair")).select(F.col("_query").alias("query_id"), "chunk_id", "score", "_k")
    best = top_per_group(rows, ["query_id"], [F.desc("score"), "chunk_id"], F.col("_k"), rank_col="rank")
    detail = chunks.select("chunk_id", F.col("file_id"), "text", "page_start", "page_end")
    return best.join(detail, "chunk_id").join(names, "file_id", "left").select(
        "query_id", F.col("file_id").alias("doc_id"), "chunk_id", "text", "filename", F.col("page_start").alias("page"),
        "page_start", "page_end", "score", "rank",
    )


def compare(q: DataFrame, chunks: DataFrame, files: DataFrame, budgets: DataFrame) -> DataFrame:
    """Balanced head, middle and tail evidence of the files of each compare request.

    ``q``: query_id, file_id, cap, file_pos. ``budgets``: query_id, budget.
    """
    from pyspark.sql import Window as W

    spans = windows.compare_windows(q, chunks)
    hits = windows.windows_to_hits(spans, files)
    order = q.select("query_id", F.col("file_id").alias("doc_id"), "file_pos")
    spot = W.partitionBy("query_id").orderBy("file_pos", "doc_id", "window_no")
    listed = hits.join(order, ["query_id", "doc_id"]).withColumn("pos", F.row_number().over(spot)).drop("file_pos")
    listed = settle(listed, "compare")
    # the order is found without the texts, which then meet their places once and are read from there by every branch
    places = evidence.round_robin(listed.select("query_id", "doc_id", "pos"), 1 << 30).select("query_id", "doc_id", "pos", "mix_pos")
    turns = listed.join(places, ["query_id", "doc_id", "pos"]).withColumn("pos", F.col("mix_pos")).select(*listed.columns)
    turns = settle(turns, "turns")
    return evidence.budget_trim_balanced(turns, budgets, order)


def scan_raw(q: DataFrame, docs: DataFrame, max_windows: int = scan.MAX_WINDOWS, context: int = scan.CONTEXT_LINES) -> DataFrame:
    """Selected line windows of every (query, file), or the file's first lines where nothing matched.

    ``q``: query_id, file_id, text. ``docs``: file_id, text. The windows of a scan over several files of
    one query are shared: max_windows div number of files.
    """
    counts = q.groupBy("query_id").agg(F.count("*").alias("_files"))
    share = q.join(counts, "query_id").withColumn("max_windows", F.greatest(F.lit(1), F.floor(F.lit(max_windows) / F.col("_files"))).cast("int"))
    return scan.scan_windows(share, docs, "max_windows", context)


def search_chunks(
    q: DataFrame, chunks: DataFrame, vectors: DataFrame, files: DataFrame, k: int, embed_query: Callable[[DataFrame], DataFrame] = embed,
    **scope,
) -> DataFrame:
    """The search command: ranked chunks of one scope (user, chat, file_ids, tags, between: those of ``scope_filter``) with previews.

    ``q``: query_id and vector, or text to embed. The scope is cut before the ranking, so k chunks come back where it has them.
    """
    asked = q if "vector" in q.columns else embed_query(q.select("query_id", "text"))
    inside = scope_filter(chunks, **scope)
    narrow = vectors.select("chunk_id", "vector").join(inside.select("chunk_id"), "chunk_id", "left_semi") if scope else vectors
    return search(vector_topk(asked.select("query_id", "vector"), narrow, k), inside.select("chunk_id", "file_id", "text"), files)


def search_chunks(
    q: DataFrame, chunks: DataFrame, vectors: DataFrame, files: DataFrame, k: int, embed_query: Callable[[DataFrame], DataFrame] = embed,
    **scope,
) -> DataFrame:
    """The search command: ranked chunks of one scope (user, chat, file_ids, tags, between: those of ``scope_filter``) with previews.

    ``q``: query_id and vector, or text to embed. The scope is cut before the ranking, so k chunks come back where it has them.
    """
    asked = q if "vector" in q.columns else embed_query(q.select("query_id", "text"))
    inside = scope_filter(chunks, **scope)
    narrow = vectors.select("chunk_id", "vector").join(inside.select("chunk_id"), "chunk_id", "left_semi") if scope else vectors
    return search(vector_topk(asked.select("query_id", "vector"), narrow, k), inside.select("chunk_id", "file_id", "text"), files)


def find_in_documents(q: DataFrame, documents: DataFrame, **options) -> DataFrame:
    """Literal find over the documents chats show. ``documents``: file_id, blocks."""
    blocks = documents.select("file_id", F.posexplode("blocks").alias("block_index", "_b")).select(
        "file_id", "block_index", F.col("_b.text").alias("text"), F.col("_b.metadata.page").alias("page")
    )
    return find.find_literal(q, blocks, **options)


def find_in_chats(q: DataFrame, documents: DataFrame, **options) -> DataFrame:
    """Literal find over what each chat shows of a file, with editor positions.

    ``q``: query_id, chat_id, file_id, needle; a file that the chat does not have gives nothing. ``documents`` are those of
    ``effective_document``: an edited page is read as its tree, blocks and rebuilt texts as the tree made of them, so all
    three are searched alike. Columns: query_id, chat_id, file_id, origin, match_no, block_index, start, end, snippet,
    from_pos, to_pos.
    """
    keys = ["chat_id", "file_id"]
    # only documents that are asked about are laid out
    asked = q.withColumn("_doc", F.to_json(F.struct(*keys)))
    wanted = asked.select(*keys, "_doc").distinct()
    shown = documents.join(wanted, keys)
    tree = F.coalesce("doc", trees.blocks_to_tree(F.coalesce("blocks", blocks_from_text(F.col("text")))))
    laid = shown.filter("origin <> 'none'").select(F.col("_doc").alias("file_id"), tree.alias("doc"))
    runs = settle(trees.tree_text_runs(laid, ["file_id"]), "runs")
    found = find.find_literal(asked.select("query_id", F.col("_doc").alias("file_id"), "needle"), trees.run_blocks(runs, ["file_id"]), **options)
    placed = find.to_positions(found, runs).withColumnRenamed("file_id", "_doc")
    return placed.join(shown.select("_doc", *keys, "origin"), "_doc").select(
        "query_id", *keys, "origin", "match_no", "block_index", "start", "end", "snippet", "from_pos", "to_pos")


def evaluate(gold: DataFrame, pred: DataFrame | None, k: int, **limits) -> DataFrame:
    """One report row: retrieval, grounding, latency and the threshold verdict."""
    rows = gold if pred is None else joins.merge_predictions(gold, pred, ["retrieved_doc_ids", "answer", "latency_ms"])
    grounding, latency = reports.evaluate_grounding(rows), reports.latency_summary(rows, "latency_ms")
    row = lambda df: df.select(F.struct(*df.columns).alias("r")).scalar()
    report = reports.evaluate_retrieval(rows, k).withColumn("_g", row(grounding)).withColumn("_l", row(latency))
    return reports.quality_gate(report.select("*", "_g.*", "_l.*").drop("_g", "_l"), **limits)


def index_health(chunks: DataFrame, vectors: DataFrame, embedder: Callable[[DataFrame], DataFrame] = embed, delete_orphans: bool = False):
    """(issues, new vectors, report) of the chunk store against the vector index."""
    issues = joins.index_issues(chunks, vectors).filter(F.col("issue").isNotNull())
    fixed, report = joins.repair_index(chunks, vectors, embedder, delete_orphans)
    return issues, fixed, report


def line_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """One chunk per non-blank line: the smallest chunker, numbered inside the document's row."""
    rest = [c for c in docs.columns if c != text]
    pairs = F.filter(
        F.transform(F.split(text, "\n"), lambda s, i: F.struct((i + 1).alias("line_no"), s.alias("line"))),
        lambda p: p["line"] != "",
    )
    rows = docs.select(*rest, F.posexplode(pairs).alias("seq", "_p"))
    return rows.select(*rest, "seq", F.col("_p.line_no").alias("line_no"), F.col("_p.line").alias("text")).withColumn(
        "content_id", chunk_id(F.col("file_id"), F.col("seq"), F.col("text"))
    )
