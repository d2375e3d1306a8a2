"""Queries of the scalar text operators and markup extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import markup as M
from corpusloom.functions import text as T
from corpusloom.operators import validate as V
from corpusloom.plans.catalog import MARKED_UP, marked_up, query, table

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
PARAGRAPHS = rf"list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n[ \t]*\n[ \t\n]*'), lambda p: {_STRIP.format('p')}), lambda p: length(p) >= 1)"


def _paragraphs(df: DataFrame) -> DataFrame:
    return df.withColumn("paragraphs", T.split_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@query(f"SELECT doc_id, (i - 1)::INT AS idx, ps[i] AS paragraph FROM (SELECT doc_id, {PARAGRAPHS} AS ps FROM documents), range(1, len(ps) + 1) AS t(i)")
def p01_paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _paragraphs(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.posexplode("paragraphs").alias("idx", "paragraph"))


@query(r"SELECT doc_id, trim(replace(replace(chr(65279) || ' ' || text || chr(13) || chr(10), chr(13) || chr(10), chr(10)), chr(13), chr(10))[2:], chr(10) || ' ' || chr(9)) AS normal FROM documents")
def p02_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("﻿ "), "text", F.lit("\r\n"))
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(raw).alias("normal"))


@query(
    r"SELECT doc_id, regexp_replace(name, '(?i)(\.txt|\.wiki)$', '') AS stem, regexp_replace(regexp_replace(name, '(?i)(\.txt|\.wiki)$', ''), '(?i)(_translated|_chinese|_zh-cn|_中文|_zh|-zh|_cn|-cn|\.zh|\.cn)+$', '') AS derived,"
    r" upper(regexp_replace(regexp_replace(trim(name), '[\s_]+', '-', 'g'), '-{2,}', '-', 'g')) AS key FROM (SELECT doc_id, source || '_ page ' || doc_id || CASE doc_id % 3 WHEN 0 THEN '_zh_CN.TXT' WHEN 1 THEN '-cn.wiki' ELSE '.txt' END AS name FROM documents)"
)
def p03_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 3 == 0, "_zh_CN.TXT").when(F.col("doc_id") % 3 == 1, "-cn.wiki").otherwise(".txt")
    name = F.concat("source", F.lit("_ page "), F.col("doc_id").cast("string"), tail)
    extensions = (".txt", ".wiki")
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_extension(name, extensions).alias("stem"), T.derive_id(name, extensions).alias("derived"), T.normalize_id(name).alias("key"))


_PLAIN = r"regexp_replace({}, '(?s)\{{\{{\{{.*?\}}\}}\}}', ' ', 'g')"
_PLAIN_SQL = "hyp"
for _pattern in (r"(?s)\{\{\{.*?\}\}\}", r"\[\[/?[^\]]*\]\]", r"""https?://[^\s\]|<>"'']+""", r"(?m)^\s*(\+{1,6})\s", r"(?m)^\s*[>#*]\s+"):
    _PLAIN_SQL = f"regexp_replace({_PLAIN_SQL}, '{_pattern}', ' ', 'g')"
for _marker in T.INLINE_MARKERS:
    _PLAIN_SQL = f"replace({_PLAIN_SQL}, '{_marker}', '')"
PLAIN_SQL = _STRIP.format(rf"regexp_replace({_PLAIN_SQL}, '[ \t]+', ' ', 'g')")
_CJK_SQL = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3000}-\x{303f}]"


@query(f"WITH {MARKED_UP} SELECT doc_id, {PLAIN_SQL} AS plain FROM marked")
def p07_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_up(spark, sf_dir).select("doc_id", T.plain_text(F.col("hyp")).alias("plain"))


@query(f"WITH {MARKED_UP} SELECT doc_id, round(coalesce(len(regexp_extract_all(hyp, '{_CJK_SQL}')) / nullif(length(hyp), 0)::DOUBLE, 0), 8) AS cjk, round(coalesce(len(regexp_extract_all(hyp, '[A-Za-z]')) / nullif(length(hyp), 0)::DOUBLE, 0), 8) AS latin FROM marked")
def p08_script_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    hyp = F.col("hyp")
    return marked_up(spark, sf_dir).select("doc_id", F.round(T.cjk_ratio(hyp), 8).alias("cjk"), F.round(T.latin_ratio(hyp), 8).alias("latin"))


@query(f"SELECT doc_id, sha1(text) AS sha, substr(sha1(text), 1, 12) AS short, sha1(array_to_string(list_transform(ps, lambda p: p || chr(0)), '')) AS side FROM (SELECT doc_id, text, {PARAGRAPHS} AS ps FROM documents)")
def p09_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _paragraphs(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.sha1("text").alias("sha"), F.substring(F.sha1("text"), 1, 12).alias("short"), T.side_hash(F.col("paragraphs")).alias("side"))


@query("SELECT doc_id, round(length(source) / greatest(length(text), 1)::DOUBLE, 8) AS ratio FROM documents")
def p11_length_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.length_ratio(F.col("text"), F.col("source")), 8).alias("ratio"))


@query(
    "SELECT doc_id, CASE WHEN regexp_matches(name, '(?is)^.+(-TEST|-ARC|-OLD|-NEW|-EX|-D|-J)$') THEN rtrim(regexp_replace(name, '(?is)(-TEST|-ARC|-OLD|-NEW|-EX|-D|-J)$', ''), '-_ ') ELSE name END AS page"
    " FROM (SELECT doc_id, source || CASE doc_id % 5 WHEN 0 THEN '-D' WHEN 1 THEN '--arc' WHEN 2 THEN '-OLD-D' WHEN 3 THEN '_ -new' ELSE '' END AS name FROM documents)"
)
def p12_group_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("concat(source, CASE doc_id % 5 WHEN 0 THEN '-D' WHEN 1 THEN '--arc' WHEN 2 THEN '-OLD-D' WHEN 3 THEN '_ -new' ELSE '' END)")
    return table(spark, sf_dir, "documents").select("doc_id", T.group_key(name).alias("page"))


@query(
    "SELECT doc_id, CASE WHEN instr(id, '_p') > 0 THEN split_part(id, '_p', 1) WHEN instr(id, '_w') > 0 THEN split_part(id, '_w', 1) ELSE id END AS document, pid, doc_id::INT % 10000 AS idx"
    " FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '_p0001' WHEN 1 THEN source || '_w003' WHEN 2 THEN 'my_page_w000' ELSE source END AS id, printf('%s#s%04d', source, doc_id % 10000) AS pid FROM documents)"
)
def p13_document_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rid = F.expr("CASE doc_id % 4 WHEN 0 THEN concat(source, '_p0001') WHEN 1 THEN concat(source, '_w003') WHEN 2 THEN 'my_page_w000' ELSE source END")
    pid = T.paragraph_id(F.col("source"), "s", F.col("doc_id") % 10000)
    return table(spark, sf_dir, "documents").select("doc_id", T.document_of(rid).alias("document"), pid.alias("pid"), T.paragraph_index(pid).alias("idx"))


@query(f"SELECT doc_id, array_to_string(ps, chr(10) || chr(10)) AS joined, len(ps)::INT AS n FROM (SELECT doc_id, {PARAGRAPHS} AS ps FROM documents)")
def p15_blank_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _paragraphs(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.array_join("paragraphs", "\n\n").alias("joined"), F.size("paragraphs").alias("n"))


@query(
    rf"SELECT doc_id, {_STRIP.format('b')} AS clean FROM (SELECT doc_id, regexp_replace(a, '^(?:以下是|下面是)?(?:翻译|译文)[^\n]{{0,20}}[:：]\s*\n', '') AS b FROM (SELECT doc_id, regexp_replace({_STRIP.format('raw')}, '(?s)^```[a-zA-Z]*\n(.*)\n```$', '\1') AS a"
    " FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN chr(10) || '```text' || chr(10) || text || chr(10) || '```' || chr(10) WHEN 1 THEN '以下是翻译结果：' || chr(10) || text ELSE text || ' ' END AS raw FROM documents)))"
)
def p21_output_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(r"CASE doc_id % 3 WHEN 0 THEN concat('\n```text\n', text, '\n```\n') WHEN 1 THEN concat('以下是翻译结果：\n', text) ELSE concat(text, ' ') END")
    return table(spark, sf_dir, "documents").select("doc_id", T.postprocess(raw).alias("clean"))


@query("SELECT item_id, array_to_string(string_split(text, ''), ' ') AS chars, trim(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS name FROM benchmark")
def p22_char_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.char_tokenize(F.col("text")).alias("chars"), T.safe_name(F.col("text")).alias("name"))


def _all(c: str, pattern: str, group: int = 1) -> str:
    quoted = pattern.replace("(?U)", "").replace("U)", ")").replace("'", "''")
    return f"regexp_extract_all({c}, '{quoted}', {group})"


def _tags(c: str) -> str:
    return f"list_transform({_all(c, M.TAG)}, lambda t: rtrim(lower(t), '_'))"


def _urls(c: str) -> str:
    return f"list_transform({_all(c, M.URL, 0)}, lambda u: rtrim(u, '.,;:)'))"


def _params(c: str, pattern: str = M.PARAM, lower: bool = True) -> str:
    inner = _all("x", pattern)
    found = f"flatten(list_transform({_all(c, M.CONSTRUCT, 0)}, lambda x: {inner}))"
    return f"list_transform({found}, lambda x: lower(x))" if lower else found


def _includes(c: str) -> str:
    return f"list_transform({_all(c, M.INCLUDE)}, lambda t: regexp_replace(regexp_replace(lower(trim(t)), '^:?wiki(?:-cn)?(?:-[a-z]+)?:', ''), '-(?:standalone|source|dev|base|cn|en)$', ''))"


def _modules(c: str) -> str:
    return f"list_transform({_all(c, M.MODULE)}, lambda t: lower(trim(t)))"


def _bodies(c: str) -> str:
    both = f"list_concat({_all(c, M.CODE_TAGGED)}, {_all(c, M.CODE_BRACES)})"
    return rf"list_filter(list_transform({both}, lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> '')"


def _opened(c: str) -> str:
    return rf"list_transform(list_filter(regexp_extract_all({c}, '\[\[\s*/?\s*[A-Za-z_][\w:-]*'), lambda x: NOT regexp_matches(x, '\[\[\s*/')), lambda x: lower(regexp_extract(x, '[A-Za-z_][\w:-]*')))"


def _closed(c: str) -> str:
    return f"list_transform({_all(c, M.CLOSE)}, lambda x: lower(x))"


def _protected(c: str) -> str:
    def of(kind: str, items: str) -> str:
        return f"list_transform({items}, lambda t: '{kind}|' || t)"

    words = rf"list_transform({_all(c, M.TAG_WORD, 0)}, lambda x: regexp_extract(x, '[A-Za-z_][\w:-]*'))"
    parts = [of("tag", words), of("include", f"list_transform({_all(c, M.INCLUDE)}, lambda t: trim(t))"), of("module", f"list_transform({_all(c, M.MODULE)}, lambda t: trim(t))"), of("param", _params(c, M.PARAM_NAME, False))]
    return f"flatten([{', '.join(parts)}])"


@query(
    f"WITH {MARKED_UP} SELECT doc_id, array_to_string({_tags('src')}, ',') AS tags, array_to_string({_urls('src')}, ',') AS urls, array_to_string({_params('src')}, ',') AS params, array_to_string({_includes('src')}, ',') AS includes,"
    f" array_to_string({_modules('src')}, ',') AS modules, array_to_string({_bodies('src')}, ',') AS code_bodies, len({_all('src', M.CODE, 0)})::INT AS n_code, len(regexp_extract_all(src, '(?m)^\\s*(\\+{{1,6}})\\s'))::INT AS n_heading FROM marked"
)
def x01_marker_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.localised(marked_up(spark, sf_dir), "src")
    lists = [F.array_join(c, ",").alias(c) for c in ("tags", "urls", "params", "includes", "modules", "code_bodies")]
    return found.select("doc_id", *lists, "n_code", "n_heading")


@query(f"WITH {MARKED_UP} SELECT doc_id, m AS marker, ((length(hyp) - length(replace(hyp, m, ''))) / length(m))::INT AS n FROM marked, (VALUES ('**'), ('//'), ('__'), ('--'), ('##')) AS t(m)")
def x07_inline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_up(spark, sf_dir).select("doc_id", F.explode(M.inline_counts(F.col("hyp"))).alias("marker", "n"))


@query(f"WITH {MARKED_UP} SELECT doc_id, array_to_string({_protected('hyp')}, ',') AS tokens, array_to_string({_opened('hyp')}, ',') AS opened, array_to_string({_closed('hyp')}, ',') AS closed FROM marked")
def x11_protected_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    hyp = F.col("hyp")
    tokens = F.transform(M.protected_tokens(hyp), lambda t: F.concat_ws("|", t["kind"], t["token"]))
    return marked_up(spark, sf_dir).select("doc_id", F.array_join(tokens, ",").alias("tokens"), F.array_join(M.opened(hyp), ",").alias("opened"), F.array_join(M.closed(hyp), ",").alias("closed"))


def _long(name: str, f) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{name}' AS chk, '{side}' AS side, unnest({f(c)}) AS key FROM marked" for side, c in (("s", "src"), ("h", "hyp")))


_MULTISETS = {"tag": _tags, "url": _urls, "param": _params, "include": _includes, "protected": _protected, "code_body": _bodies, "module": _modules}
_ITEMS = " UNION ALL ".join(_long(k, f) for k, f in _MULTISETS.items())
_BALANCE = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS what, unnest({f}) AS key FROM marked" for k, f in (("so", _opened("src")), ("ho", _opened("hyp")), ("hc", _closed("hyp")), ("sc", _closed("src"))))
_PAIRED = ", ".join(f"'{t}'" for t in M.PAIRED_TAGS)
_TIMES = "((length({c}) - length(replace({c}, m, ''))) / length(m))::INT"
#: Outcomes of every check in long form: doc_id, chk, checked, preserved.
OUTCOMES = (
    f"WITH {MARKED_UP}, items AS ({_ITEMS}), n AS (SELECT doc_id, chk, key, count(*) FILTER (side = 's') AS want, count(*) FILTER (side = 'h') AS got FROM items GROUP BY ALL),"
    f" sets AS (SELECT doc_id, chk, sum(want) AS checked, sum(CASE WHEN chk = 'protected' AND regexp_matches(key, '{_CJK_SQL}') THEN want ELSE least(want, got) END) AS preserved FROM n WHERE chk <> 'module' GROUP BY ALL),"
    f" cnt AS (SELECT doc_id, 'code' AS chk, len({_all('src', M.CODE, 0)}) AS a, len({_all('hyp', M.CODE, 0)}) AS b FROM marked UNION ALL SELECT doc_id, 'heading', len(regexp_extract_all(src, '(?m)^\\s*(\\+{{1,6}})\\s')), len(regexp_extract_all(hyp, '(?m)^\\s*(\\+{{1,6}})\\s')) FROM marked),"
    f" inl AS (SELECT doc_id, 'inline' AS chk, sum({_TIMES.format(c='src')} // 2) AS checked, sum(least({_TIMES.format(c='src')} // 2, {_TIMES.format(c='hyp')} // 2)) AS preserved FROM marked, (VALUES ('**'), ('//'), ('__'), ('--'), ('##')) AS t(m) GROUP BY doc_id),"
    f" b AS ({_BALANCE}), bn AS (SELECT doc_id, key, count(*) FILTER (what = 'so') AS so, count(*) FILTER (what = 'ho') AS ho, count(*) FILTER (what = 'hc') AS hc FROM b WHERE key IN ({_PAIRED}) GROUP BY ALL),"
    " bal AS (SELECT doc_id, 'balance' AS chk, sum(so) AS checked, sum(least(so, ho, hc)) AS preserved FROM bn WHERE so > 0 GROUP BY doc_id),"
    " every AS (SELECT * FROM sets UNION ALL SELECT doc_id, chk, a, least(a, b) FROM cnt UNION ALL SELECT * FROM inl UNION ALL SELECT * FROM bal),"
    " names AS (SELECT unnest(['tag', 'url', 'param', 'code', 'heading', 'inline', 'include', 'protected', 'balance', 'code_body']) AS chk),"
    " outcomes AS (SELECT d.doc_id, names.chk, coalesce(checked, 0)::INT AS checked, coalesce(preserved, 0)::INT AS preserved FROM documents d CROSS JOIN names LEFT JOIN every ON every.doc_id = d.doc_id AND every.chk = names.chk)"
)


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate(marked_up(spark, sf_dir), "src", "hyp")


@query(f"{OUTCOMES} SELECT doc_id, chk AS \"check\", checked, preserved FROM outcomes")
def v01_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _validated(spark, sf_dir).select("doc_id", F.explode_outer("outcomes").alias("check", "o"))
    return rows.select("doc_id", "check", "o.checked", "o.preserved")


@query(f"{OUTCOMES} SELECT doc_id, round(CASE WHEN sum(checked) = 0 THEN 1.0 ELSE sum(preserved) / sum(checked)::DOUBLE END, 6) AS score FROM outcomes GROUP BY doc_id")
def v02_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{OUTCOMES} SELECT chk AS \"check\", round(avg(CASE WHEN checked = 0 THEN 1.0 ELSE preserved / checked::DOUBLE END), 6) AS mean_rate FROM outcomes GROUP BY chk")
def a06_check_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_means(_validated(spark, sf_dir)).select("check", F.round("mean_rate", 6).alias("mean_rate"))


@query(
    f"{OUTCOMES} SELECT chk || '_missing' AS code, count(*) AS n FROM n WHERE chk IN ('tag', 'url', 'param', 'include', 'module') AND got < want GROUP BY chk"
)
def a18_missing_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = V.issue_counts(_validated(spark, sf_dir), 100)
    return counts.where(F.col("code").isin(*(f"{k}_missing" for k in ("tag", "url", "param", "include", "module"))))


@query()
def a06_preservation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.preservation_summary(_validated(spark, sf_dir))


@query()
def v12_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("doc_id", F.explode_outer("issues").alias("i")).where("i IS NOT NULL").select("doc_id", "i.code", "i.detail")
