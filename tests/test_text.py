import random
import re
import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first().x


def many(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, c string").select("i", f(F.col("c")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_paragraphs(spark):
    assert one(spark, "\n\na\n\n b \n \t\n\n c\nd\n\n\n", T.split_paragraphs) == ["a", "b", "c\nd"]
    assert one(spark, None, T.split_paragraphs) == [] and one(spark, "ab\n\nc", lambda c: T.split_paragraphs(c, 2)) == ["ab"]


def test_strip_is_pythons(spark):
    values = ["".join(p) for p in ("\x1c a\x1f", "　x\xa0", "\t\n", "", " a b ", "\x85é　")]
    assert many(spark, values, T.strip) == [v.strip() for v in values]


def test_normalize(spark):
    assert one(spark, "﻿﻿ \r\na\rb\t ", T.normalize_text) == "a\nb"
    assert one(spark, "\x0ba", T.normalize_text) == "\x0ba"
    assert one(spark, "﻿a ", lambda c: T.normalize_text(c, bom=False, trim=False)) == "﻿a "


def test_identifiers(spark):
    values = ["AB-173", "ab_173", " ab  173 ", "ab--173", "ＡＢ－１７３"]
    assert set(many(spark, values, T.normalize_id)) == {"AB-173"}
    assert one(spark, "AB-173_zh.txt", T.derive_id) == "AB-173" and one(spark, "x_zh_CN-cn.TXT", T.derive_id) == "x"
    assert one(spark, "①", T.normalize_id) == unicodedata.normalize("NFKC", "①")
    assert one(spark, None, T.normalize_id) == ""


def test_group_key(spark):
    assert many(spark, ["AB-1-D", "AB-1-arc", "-D", "AB-1", "AB_ -OLD"], T.group_key) == ["AB-1", "AB-1", "-D", "AB-1", "AB"]


def test_document_of(spark):
    assert many(spark, ["my_page_w000", "x_w003", "x_p0001", "x"], T.document_of) == ["my", "x", "x", "x"]
    df = spark.createDataFrame([("x#s0012",)], "c string")
    assert df.select(T.paragraph_index(F.col("c")).alias("x")).first().x == 12


def test_postprocess(spark):
    assert one(spark, " ```text\na\n```\n", T.postprocess) == "a"
    assert one(spark, "以下是翻译结果：\n正文", T.postprocess) == "正文" and one(spark, "a ``` b", T.postprocess) == "a ``` b"


def test_plain_text_against_python(spark):
    def plain(text):
        out = re.sub(r"\{\{\{.*?\}\}\}", " ", text, flags=re.S)
        for p in (r"\[\[/?[^\]]*\]\]", r"https?://[^\s\]\|<>\"']+"):
            out = re.sub(p, " ", out)
        for p in (r"^\s*(\+{1,6})\s", r"^\s*[>#*]\s+"):
            out = re.sub(p, " ", out, flags=re.M)
        for m in ("**", "//", "__", "--", "##"):
            out = out.replace(m, "")
        return re.sub(r"[ \t]+", " ", out).strip()

    r = random.Random(1)
    pieces = ["{{{", "}}}", "[[", "]]", "[[/div]]", "https://a.b/c", "\n", "\r", " ", "+ ", "++", "> ", "# ", "**", "//", "__", "--", "##", "word", "é", "漢字", "\t", "\x1c", "　"]
    values = ["".join(r.choices(pieces, k=r.randint(0, 14))) for _ in range(1500)]
    found = many(spark, values, T.plain_text)
    assert all(a == plain(v) for a, v in zip(found, values, strict=True)), next((v, a, plain(v)) for a, v in zip(found, values, strict=True) if a != plain(v))


def test_ratios_and_counts(spark):
    assert one(spark, "漢字ab", T.cjk_ratio) == 0.5 and one(spark, "", T.cjk_ratio) == 0.0
    assert many(spark, ["****a**", "***", ""], lambda c: T.count_of(c, "**")) == [3, 1, 0]
    assert one(spark, "a$1\\{source}", lambda c: T.user_prompt(c, "x {source} y")) == "x a$1\\{source} y"


def test_hash_fraction(spark):
    import hashlib

    values = [f"d{i}" for i in range(200)]
    want = [int.from_bytes(hashlib.sha1(f"s:{v}".encode()).digest()[:8], "big") / 2**64 for v in values]
    assert many(spark, values, lambda c: T.hash_fraction(c, "s:")) == want
