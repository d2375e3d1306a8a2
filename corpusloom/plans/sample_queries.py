"""Queries of splits, samples, joins, chat, tokens and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import ranks
from corpusloom.functions import text as T
from corpusloom.operators import chat, joins, metrics, splits, tokens, windows
from corpusloom.plans.catalog import query, table

_FRACTION = "('0x' || substr(sha1('scp-split-v1:' || {}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"


@query(f"SELECT doc_id, CASE WHEN {_FRACTION.format('doc_id')} < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents")
def l03_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1)


_KEYED = "g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY sha1('42:' || source), source) - 1 AS n, count(*) OVER () AS total FROM g)"
_GROUP_SPLIT = f"WITH {_KEYED}, s AS (SELECT source, CASE WHEN n < round(total * 0.8) THEN 'train' WHEN n < round(total * 0.8) + greatest(1, round(total * 0.1)) THEN 'val' ELSE 'test' END AS split FROM r)"


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_split(table(spark, sf_dir, "documents"), "source")


@query(f"{_GROUP_SPLIT} SELECT doc_id, split FROM documents JOIN s USING (source)")
def l01_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("doc_id", "split")


_LEAKS = (
    f"{_GROUP_SPLIT}, d AS (SELECT doc_id, split, sha1(text) AS a, sha1(lang || substr(text, 1, 40)) AS b FROM documents JOIN s USING (source)),"
    " t AS (SELECT a AS h FROM d WHERE split = 'train' UNION SELECT b FROM d WHERE split = 'train'),"
    " v AS (SELECT * FROM d WHERE split = 'val' AND a NOT IN (SELECT h FROM t) AND b NOT IN (SELECT h FROM t)),"
    " tv AS (SELECT h FROM t UNION SELECT a FROM v UNION SELECT b FROM v),"
    " kept AS (SELECT * FROM d WHERE split = 'train' UNION ALL SELECT * FROM v UNION ALL SELECT * FROM d WHERE split = 'test' AND a NOT IN (SELECT h FROM tv) AND b NOT IN (SELECT h FROM tv))"
)


@query(f"{_LEAKS} SELECT doc_id, split FROM kept")
def l02_leak_free_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _grouped(spark, sf_dir).select("doc_id", "split", F.sha1("text").alias("a"), F.sha1(F.concat("lang", F.substring("text", 1, 40))).alias("b"))
    return splits.remove_leaks(hashed, "a", "b").select("doc_id", "split")


@query(f"{_GROUP_SPLIT} SELECT split, count(*) AS rows, count(DISTINCT source) AS groups, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents JOIN s USING (source) GROUP BY split")
def a11_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_stats(_grouped(spark, sf_dir), "split", "source", "n_chars", "doc_id").drop("ids")


@query(f"WITH {_KEYED} SELECT doc_id, CASE WHEN n < floor(total * 0.3) THEN 'val' ELSE 'train' END AS split FROM documents JOIN r USING (source)")
def l04_page_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.holdout(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 0.3).select("doc_id", "split")


_ROBIN = "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1('42:' || doc_id), doc_id)::INT AS turn FROM documents ORDER BY turn, sha1('42:' || source), source LIMIT 300"


@query(_ROBIN)
def w06_round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 300)


@query(f"WITH c AS (SELECT source, count(*) AS n FROM ({_ROBIN}) GROUP BY source) SELECT count(*) AS docs, min(n) AS least, list_sort(list(n))[count(*) // 2 + 1] AS median, max(n) AS most FROM c")
def a14_sample_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.coverage(w06_round_robin_sample(spark, sf_dir), "source")


@query(
    "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),"
    " b AS (SELECT i, i * n // 7 AS lo, (i + 1) * n // 7 AS hi, 100 // 7 + CASE WHEN i < 100 % 7 THEN 1 ELSE 0 END AS take FROM range(0, 7) AS t(i), (SELECT count(*) AS n FROM documents)),"
    " picks AS (SELECT lo + CASE WHEN take >= hi - lo THEN j ELSE floor(j * ((hi - lo) / take::DOUBLE))::BIGINT END AS pos FROM b, range(0, least(take, hi - lo)) AS u(j))"
    " SELECT doc_id, n_chars FROM r JOIN picks USING (pos)"
)
def w07_strata_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.strata_sample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 100, 7)


@query("SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 16 AS batch, sha1('3:' || '3:' || ((row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 16)) AS batch_key FROM documents")
def l07_length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return splits_batches(docs).select("doc_id", "batch", "batch_key")


def splits_batches(docs: DataFrame) -> DataFrame:
    return tokens.length_batches(docs, "n_chars", "doc_id", 16, 3, 0)


_PAIRS = "pairs AS (SELECT * FROM (SELECT conv_id, turn, role, text AS source, lead(role) OVER w AS nr, lead(text) OVER w AS target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.turn_pairs(table(spark, sf_dir, "conversations"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, source, target FROM pairs")
def w10_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"WITH {_PAIRS} SELECT conv_id, turn, source, target FROM pairs WHERE length(source) >= 24 AND source <> target")
def f03_short_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where((F.length("source") >= 24) & (F.col("source") != F.col("target")))


_PROMPT = "'Convert:' || chr(10) || source || chr(10) || 'Done.'"


@query(f"WITH {_PAIRS} SELECT conv_id || '_' || turn AS id, 'translate' AS task, 3::INT AS n, 'system' AS first_role, {_PROMPT} AS prompt, target AS answer FROM pairs")
def p18_chat_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumn("id", F.concat_ws("_", "conv_id", "turn"))
    made = chat.chat_samples(rows, "id", "Convert:\n{source}\nDone.", system="Be exact.")
    at = lambda i: F.get("messages", F.lit(i))
    return made.select("id", "task", F.size("messages").alias("n"), at(0)["role"].alias("first_role"), at(1)["content"].alias("prompt"), at(2)["content"].alias("answer"))


@query(
    f"WITH {_PAIRS} SELECT conv_id, turn, '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {_PROMPT} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || target || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS rendered FROM pairs"
)
def p19_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.to_messages(T.user_prompt(F.col("source"), "Convert:\n{source}\nDone."), F.col("target"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", chat.render(messages, generation=True).alias("rendered"))


@query(f"WITH {_PAIRS} SELECT count(*) AS total, count(DISTINCT conv_id) AS pages FROM pairs")
def p28_sft_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.sft_counts(_pairs(spark, sf_dir), "conv_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN source ELSE lang END AS hypothesis FROM documents")
def p20_pick_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("hypothesis"), F.when(F.col("doc_id") % 3 == 1, F.col("source")).alias("output"),
        F.array(chat.message("user", F.lit("q")), chat.message("assistant", F.col("lang"))).alias("messages"),
    )
    return rows.select("doc_id", chat.pick_hypothesis(rows).alias("hypothesis"))


_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"
_UNITS = f"units AS (SELECT conv_id, turn, source, target, ({_WORDS.format('source')} + {_WORDS.format('target')})::BIGINT AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM pairs)"
_PACK = (
    f"WITH RECURSIVE {_PAIRS}, {_UNITS}, pk AS (SELECT conv_id, k, turn, cost, cost AS acc, 0 AS w FROM units WHERE k = 1 UNION ALL"
    " SELECT u.conv_id, u.k, u.turn, u.cost, CASE WHEN pk.acc + u.cost > 260 THEN u.cost ELSE pk.acc + u.cost END, CASE WHEN pk.acc + u.cost > 260 THEN pk.w + 1 ELSE pk.w END FROM pk JOIN units u ON u.conv_id = pk.conv_id AND u.k = pk.k + 1)"
)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = T.whitespace_tokens(F.col("source")) + T.whitespace_tokens(F.col("target"))
    return _pairs(spark, sf_dir).withColumn("cost", cost.cast("long"))


@query(f"WITH {_PAIRS}, {_UNITS} SELECT conv_id, turn, cost, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS upto FROM units")
def w01_running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.running_cost(_units(spark, sf_dir), "conv_id", "turn", "cost").select("conv_id", "turn", "cost", "upto")


@query(f'{_PACK} SELECT conv_id, turn, cost, w::INT AS "window" FROM pk')
def w02_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack_windows(_units(spark, sf_dir), "conv_id", "turn", "cost", 260).select("conv_id", "turn", "cost", "window")


_WINDOWS = f"{_PACK}, win AS (SELECT pk.conv_id, pk.w, string_agg(u.source, chr(10) || chr(10) ORDER BY u.turn) AS source, string_agg(u.target, chr(10) || chr(10) ORDER BY u.turn) AS target, sum(pk.cost)::BIGINT AS tokens, min(pk.turn) AS unit_start, max(pk.turn) + 1 AS unit_end, count(*) AS n FROM pk JOIN units u ON pk.conv_id = u.conv_id AND pk.turn = u.turn GROUP BY ALL)"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = windows.pack_windows(_units(spark, sf_dir), "conv_id", "turn", "cost", 260)
    return windows.window_rows(packed, "conv_id", "turn", "source", "target", "cost")


@query(f'{_WINDOWS} SELECT conv_id, w::INT AS "window", source, target, tokens, unit_start, unit_end, n AS paragraphs_source, n AS paragraphs_target FROM win')
def a17_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)


@query(f'{_WINDOWS} SELECT conv_id, w::INT AS "window", tokens FROM win WHERE conv_id NOT IN (SELECT conv_id FROM win WHERE tokens > 260)')
def f05_drop_over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drop_over_budget(_windows(spark, sf_dir), "conv_id", "tokens", 260).select("conv_id", "window", "tokens")


@query(f"{_WINDOWS} SELECT split, count(*) AS samples, sum((tokens > 260)::INT)::BIGINT AS over_budget, count(DISTINCT conv_id) AS docs FROM (SELECT *, CASE WHEN {_FRACTION.format('conv_id')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM win) GROUP BY split")
def a12_dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = windows.drop_over_budget(_windows(spark, sf_dir), "conv_id", "tokens", 260, keep=True)
    done = splits.hash_split(kept, "conv_id", 0.2)
    return done.groupBy("split").agg(F.count(F.lit(1)).alias("samples"), F.count_if("over_budget").alias("over_budget"), F.countDistinct("conv_id").alias("docs"))


@query(
    f"{_WINDOWS}, s AS (SELECT list_sort(list(tokens)) AS v, count(*) AS n, round(avg(tokens), 1) AS mean FROM win)"
    " SELECT n, v[1] AS least, v[(0.5 * (n - 1))::BIGINT + CASE WHEN (0.5 * (n - 1))::BIGINT > 0.5 * (n - 1) THEN 0 ELSE 1 END] AS p50, v[floor(0.9 * (n - 1))::BIGINT + 1] AS p90, v[floor(0.99 * (n - 1))::BIGINT + 1] AS p99, v[n // 2 + 1] AS upper, v[round_even(0.95 * (n - 1), 0)::BIGINT + 1] AS p95, v[n] AS most, mean FROM s"
)
def a03_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, rows = F.col("tokens"), _windows(spark, sf_dir)
    sums = rows.agg(F.count(t).alias("n"), F.min(t).alias("least"), F.max(t).alias("most"), F.round(F.avg(t), 1).alias("mean"))
    wanted = {"p50": ("floor", 0.5), "p90": ("floor", 0.9), "p99": ("floor", 0.99), "upper": ("upper", 0.5), "p95": ("nearest", 0.95)}
    return ranks.beside(sums, ranks.order_statistics(rows, "tokens", wanted)).select("n", "least", "p50", "p90", "p99", "upper", "p95", "most", "mean")


_OVERLAP = (
    f"WITH RECURSIVE {_PAIRS}, {_UNITS}, s AS (SELECT conv_id, k - 1 AS k, cost, sum(cost) OVER (PARTITION BY conv_id ORDER BY k) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM units),"
    " ends AS (SELECT a.conv_id, a.k AS first, any_value(a.n) AS n, greatest(max(b.k) FILTER (b.upto - a.upto + a.cost <= 260) + 1, a.k + 1) AS last FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.k >= a.k GROUP BY a.conv_id, a.k),"
    " r AS (SELECT conv_id, 0 AS w, first, coalesce(last, first + 1) AS last, n FROM ends WHERE first = 0 UNION ALL"
    " SELECT r.conv_id, r.w + 1, e.first, coalesce(e.last, e.first + 1), r.n FROM r JOIN ends e ON e.conv_id = r.conv_id AND e.first = greatest(r.first + 1, r.last - 1) WHERE r.last < r.n)"
)


@query(f'{_OVERLAP} SELECT conv_id, w::INT AS "window", first::INT AS unit_start, last::INT AS unit_end FROM r')
def w03_overlapping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.overlapping_windows(_units(spark, sf_dir), "conv_id", "turn", "cost", 260, 1)


@query()
def n05_plan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return windows.plan_windows(docs, "doc_id", "text", 200)


_IDS = "list_transform(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''), lambda x: ('0x' || substr(sha1(x), 1, 7))::INT)"
_ENCODED = f"WITH {_PAIRS}, e AS (SELECT conv_id, turn, {_IDS.format('source')} AS p, list_concat({_IDS.format('source')}, {_IDS.format('target')}) AS ids FROM pairs), x AS (SELECT conv_id, turn, CASE WHEN len(ids) = 0 THEN 'empty' WHEN len(ids) <= 120 THEN 'ok' ELSE 'truncated' END AS status, ids[1:120] AS ids, list_transform(ids, lambda v, i: CASE WHEN i <= len(p) THEN -100 ELSE v END)[1:120] AS labels FROM e)"


def _encoded(spark: SparkSession, sf_dir: str, policy: str = "truncate") -> DataFrame:
    return tokens.encode(_pairs(spark, sf_dir), "source", "target", 120, policy)


def _text(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query(f"{_ENCODED} SELECT conv_id, turn, status, array_to_string(ids, ',') AS input_ids, array_to_string(labels, ',') AS labels, len(ids)::INT AS n FROM x")
def n06_encode_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir).select("conv_id", "turn", "status", _text("input_ids"), _text("labels"), F.size("attention_mask").alias("n"))


@query(f"{_ENCODED} SELECT CASE status WHEN 'truncated' THEN 'overlong' ELSE status END AS status, count(*) AS n, sum(CASE WHEN status = 'ok' THEN len(ids) ELSE 0 END)::BIGINT AS tokens FROM x GROUP BY 1")
def n10_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.stats(_encoded(spark, sf_dir, "drop"))


@query(
    f"WITH RECURSIVE {_ENCODED[5:]}, u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, ids, labels, len(ids) AS cost FROM x WHERE len(ids) > 0),"
    " pk AS (SELECT conv_id, k, cost AS acc, 0 AS w FROM u WHERE k = 1 UNION ALL SELECT u.conv_id, u.k, CASE WHEN pk.acc + u.cost > 300 THEN u.cost ELSE pk.acc + u.cost END, CASE WHEN pk.acc + u.cost > 300 THEN pk.w + 1 ELSE pk.w END FROM pk JOIN u ON u.conv_id = pk.conv_id AND u.k = pk.k + 1)"
    " SELECT conv_id, w::INT AS bin, array_to_string(flatten(list(ids ORDER BY u.k)), ',') AS input_ids, array_to_string(flatten(list(labels ORDER BY u.k)), ',') AS labels FROM pk JOIN u USING (conv_id, k) GROUP BY conv_id, w"
)
def n07_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = tokens.pack_sequences(_encoded(spark, sf_dir), "conv_id", "turn", 300)
    return packed.select("conv_id", "bin", _text("input_ids"), _text("labels"))


@query(
    f"{_ENCODED} SELECT conv_id, turn, w AS width, array_to_string(list_concat(ids, list_transform(range(len(ids), w), lambda i: 0)), ',') AS input_ids, array_to_string(list_concat(labels, list_transform(range(len(ids), w), lambda i: -100)), ',') AS labels"
    " FROM (SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY conv_id) / 8.0) * 8)::INT AS w FROM x WHERE len(ids) > 0)"
)
def n08_pad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = tokens.pad_batches(_encoded(spark, sf_dir).where(F.col("input_ids").isNotNull()), "conv_id")
    return padded.select("conv_id", "turn", F.size("input_ids").alias("width"), _text("input_ids"), _text("labels"))


@query(
    "SELECT coalesce(a.k, b.k) AS k, coalesce(a.doc_id, -1) AS left_id, coalesce(b.page_id, -1) AS right_id FROM (SELECT upper('K-' || doc_id) AS k, doc_id FROM documents) a"
    " FULL OUTER JOIN (SELECT upper('K-' || (3 * page_id)) AS k, page_id FROM pages) b ON a.k = b.k"
)
def j01_full_outer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def keyed(name: str, row_id: str, key: str, to: str) -> DataFrame:
        number = F.expr(f"cast({key} as string)")
        return table(spark, sf_dir, name).select(F.col(row_id).alias(to), T.normalize_id(F.concat_ws("_", F.lit("k"), number), compose=False).alias("k"))

    pairs = joins.paired(keyed("documents", "doc_id", "doc_id", "left_id"), keyed("pages", "page_id", "3 * page_id", "right_id"), "k")
    return pairs.select("k", F.coalesce("left_id", F.lit(-1)).alias("left_id"), F.coalesce("right_id", F.lit(-1)).alias("right_id"))


@query(
    "WITH refs AS (SELECT source || '::' || doc_id AS id, text AS target FROM documents), preds AS (SELECT doc_id, source || '::' || (doc_id + doc_id % 2) AS id FROM documents),"
    " fb AS (SELECT split_part(id, '::', 1) AS k, arg_min(target, id) AS target FROM refs GROUP BY 1) SELECT doc_id, coalesce(refs.target, fb.target) AS target FROM preds LEFT JOIN refs USING (id) LEFT JOIN fb ON fb.k = split_part(preds.id, '::', 1)"
)
def j04_prediction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    refs = docs.select(F.concat_ws("::", "source", "doc_id").alias("id"), F.col("text").alias("target"))
    preds = docs.select("doc_id", F.expr("concat(source, '::', doc_id + doc_id % 2)").alias("id"))
    return joins.with_reference(preds, refs, "id", ["target"], order="id").select("doc_id", "target")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j05_resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.not_done(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id")
def j06_cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.probe(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])


@query("SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) AS total FROM (SELECT d.doc_id, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id)")
def a15_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j06_cache_probe(spark, sf_dir).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count(F.lit(1)).alias("total"))


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def w09_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.keep_first(table(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")]).select("source", "doc_id", "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE length(trim(text)) > 0 ORDER BY n_chars DESC, doc_id LIMIT 25")
def s08_largest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0)
    return docs.orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3') AND NOT regexp_matches(lang, '^(e.*|d[ae])$')")
def f06_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.chosen(table(spark, sf_dir, "documents"), "source", ["src1", "src2", "src3"], "lang", ["e*", "d[ae]"]).select("doc_id", "source")


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1('42:' || doc_id), doc_id) AS turn FROM documents) SELECT doc_id, source FROM r ORDER BY turn, sha1('42:' || source), source LIMIT 200")
def l05_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.subsample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 200)


@query("SELECT d.doc_id, d.n_chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j02_common_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("toxic = 1").withColumn("pos", -F.col("doc_id"))
    return joins.in_order(labels, table(spark, sf_dir, "documents"), "doc_id", "pos").select("doc_id", "n_chars")


@query(f"WITH {_PAIRS}, {_UNITS} SELECT conv_id, turn, cost FROM units WHERE cost <= 120")
def f04_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.within_budget(_units(spark, sf_dir), F.col("cost"), 120).select("conv_id", "turn", "cost")


@query("SELECT doc_id, count(*) AS tables FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 UNION ALL SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT DISTINCT doc_id FROM documents UNION ALL SELECT DISTINCT page_id AS doc_id FROM pages) GROUP BY doc_id")
def u01_union_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return joins.union_keys(labels.where("quality = 0"), labels.where("toxic = 1"), docs, pages, key="doc_id")


_CHATS = "chats AS (SELECT conv_id, last(role ORDER BY turn) AS role, bool_or(text IS NULL OR role IS NULL) AS broken, count(*) AS n FROM conversations GROUP BY conv_id)"


@query(f"WITH {_CHATS} SELECT conv_id, n::INT AS n, CASE WHEN role = 'assistant' AND NOT broken THEN 'ok' ELSE 'malformed' END AS status FROM chats")
def n12_message_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.conversations(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", F.size("messages").alias("n"), chat.message_status(F.col("messages")).alias("status"))


_ALL_WORDS = _WORDS.format("text")


@query(
    f"WITH {_CHATS}, w AS (SELECT conv_id, sum({_ALL_WORDS}) AS words FROM conversations GROUP BY conv_id), x AS (SELECT words, CASE WHEN role <> 'assistant' OR broken THEN 'malformed' WHEN words = 0 THEN 'empty' WHEN words <= 200 THEN 'ok' ELSE 'overlong' END AS status FROM chats JOIN w USING (conv_id))"
    " SELECT status, count(*) AS n, sum(CASE WHEN status = 'ok' THEN words ELSE 0 END)::BIGINT AS tokens FROM x GROUP BY status"
)
def n09_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.conversations(table(spark, sf_dir, "conversations"))
    return tokens.stats(tokens.encode_messages(chats, 200))


@query("SELECT source, count(*) AS steps, sum(n_chars)::BIGINT AS tokens, sum(length(lang) / 2.0)::DOUBLE AS seconds, sum(n_chars) / sum(length(lang) / 2.0)::DOUBLE AS tokens_per_second, count(*) / sum(length(lang) / 2.0)::DOUBLE AS steps_per_second, sum(length(lang) / 2.0)::DOUBLE / count(*) AS seconds_per_step FROM documents GROUP BY source")
def a16_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").withColumn("seconds", F.length("lang") / F.lit(2.0))
    return metrics.throughput(runs, "source", "n_chars", "seconds")
