import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.config import EngineConfig, canonical_json, check_chunking, configuration_hash, sha256
from marginalia.functions.canon import canon
from marginalia.functions.chunking import check_chunking, chunk_list, chunks, whitespace_chunks
from marginalia.functions.hashing import provenance_hash, vector_width
from marginalia.functions.tokens import InvalidTokenizer, Tokenizer, WhitespaceTokenizer, make_tokenizer, trim_partial, whitespace_tokens
from marginalia.functions.vectors import cosine_distance, parse_vector
from marginalia.spec import DocumentSpec

SPEC = DocumentSpec(("name", "sku", "price"), ("category.name", "brand.name", "features.name"))


def texts(spark, values, kind):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)])
    df = spark.createDataFrame(list(enumerate(values)), schema)
    return [r[0] for r in df.orderBy("i").select(canon(F.col("v"), kind)).collect()]


def test_canon_by_type(spark):
    assert texts(spark, [True, False, None], T.BooleanType()) == ["true", "false", ""]
    assert texts(spark, [1.5, 10.0, 0.1234567, -2.0, 0.0, float("nan"), float("inf"), 1e300, None], T.DoubleType()) == ["1.5", "10", "0.123457", "-2", "0", "NaN", "Infinity", "1.0E300", ""]
    assert texts(spark, [Decimal("10"), Decimal("49.90"), None], T.DecimalType(10, 2)) == ["10.00", "49.90", ""]
    assert texts(spark, [dt.datetime(2024, 1, 2, 3, 4, 5, 678)], T.TimestampNTZType()) == ["2024-01-02T03:04:05+00:00"]
    assert texts(spark, [dt.date(2024, 1, 2)], T.DateType()) == ["2024-01-02T00:00:00+00:00"]
    assert texts(spark, [7, None], T.LongType()) == ["7", ""]


def test_canon_lists(spark):
    kind = T.ArrayType(T.StringType())
    steps = ["Step 3: Submit", "Step 1: Login", "Step 2: Verify"]
    assert texts(spark, [steps, ["b", None, "a", "b"], [], None, ["é", "b", "B", "a"]], kind) == ["Step 1: Login, Step 2: Verify, Step 3: Submit", ", a, b, b", "", "", "B, a, b, é"]
    df = spark.createDataFrame([(steps,)], T.StructType([T.StructField("v", kind)]))
    assert df.select(canon(F.col("v"), kind, ordered=True)).first()[0] == ", ".join(steps)
    nested = T.ArrayType(kind)
    df = spark.createDataFrame([([["b", "a"], ["0"]],)], T.StructType([T.StructField("v", nested)]))
    assert df.select(canon(F.col("v"), nested, ordered=True)).first()[0] == "a, b, 0"  # inner lists are sorted even so


def test_golden_hashes(spark):
    text = "name: Speaker\nsku: SPK-001\nprice: 49.99\ncategory.name: Electronics\nbrand.name: Acme\nfeatures.name: Bluetooth, Waterproof"
    assert sha256(text) == "3a0c1a984f5863a9fa7d9bd3ca0f54941d9ac2f43111fa0caf1107aa85b3c2cf"
    assert configuration_hash(SPEC, EngineConfig()) == "d9b00733b97eeb7051d8944644383d20774282b4cb3781de4390485b3b4ec6b7"
    got = spark.range(1).select(provenance_hash(F.lit("content-hash"), "openai", "text-embedding-3-small", 1536)).first()[0]
    assert got == "ee4cbe6e38f4f8b08f1e97e2d742272887b0915a687ca6ec3876d6a5c6ae8122"
    row = chunks(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t", EngineConfig()).collect()
    assert [(r.chunk_index, r.content_hash) for r in row] == [(0, "68f3f008e35651bb163dccf93aaf113a88729fbcf9b36b67d18ad46084c21e8a")]


def test_configuration_hash_depends_on_each_setting():
    base = configuration_hash(SPEC, EngineConfig())
    changes = [dict(max_tokens=399), dict(overlap=39), dict(provider="x"), dict(model="y"), dict(dimensions=8), dict(tokenizer="tiktoken")]
    assert len({base, configuration_hash(SPEC.keep_order("features.name"), EngineConfig()), *(configuration_hash(SPEC, EngineConfig(**c)) for c in changes)}) == 8
    assert canonical_json({"b": 1, "a": [2, 1], "c": "é/ "}) == '{"a":[2,1],"b":1,"c":"é/\\u2028"}'


def test_whitespace_tokens(spark):
    values = ["one two   three", "", "   \n\t  ", None, "a b", "a ", "\f", "x\r\ny"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(whitespace_tokens(F.col("t"))).collect()]
    python = [WhitespaceTokenizer().encode(v) for v in values]
    assert got == python == [["one", "two", "three"], [], [], [], ["a", "b"], ["a", ""], ["", ""], ["x", "y"]]


def test_chunk_boundaries(spark):
    def cut(text, most, overlap):
        df = spark.createDataFrame([(text,)], "t string")
        return df.select(whitespace_chunks(F.col("t"), most, overlap)).first()[0]

    assert cut("a b c d e f g h", 4, 1) == ["a b c d", "d e f g", "g h"]
    assert cut("one two three", 10, 2) == ["one two three"]
    assert cut("", 4, 1) == cut(" \n\t ", 4, 1) == cut(None, 4, 1) == []
    for bad in ((4, 4), (4, 5), (0, 0), (4, -1)):
        with pytest.raises(ValueError):
            check_chunking(*bad)


@given(st.integers(0, 200), st.integers(1, 20), st.integers(0, 19))
@settings(max_examples=200, deadline=None)
def test_chunks_equal_the_loop(n, most, overlap):
    if overlap >= most:
        return
    tokens = [str(i) for i in range(n)]
    want, start = [], 0
    while start < n:
        want.append(" ".join(tokens[start : start + most]))
        if start + most >= n:
            break
        start += most - overlap
    assert chunk_list(tokens, most, overlap, WhitespaceTokenizer()) == want


class PipeTokenizer:
    def encode(self, text):
        return text.split("|")

    def decode(self, tokens):
        return "-".join(tokens)

    def identifier(self):
        return "pipe"


def test_tokenizers():
    assert chunk_list(PipeTokenizer().encode("a|b|c|d"), 2, 0, PipeTokenizer()) == ["a-b", "c-d"]
    assert isinstance(PipeTokenizer(), Tokenizer) and make_tokenizer("whitespace").identifier() == "whitespace"
    for driver in ("no.such.Class", "marginalia.nothing", "builtins.dict", "plain"):
        with pytest.raises(InvalidTokenizer):
            make_tokenizer(driver)
    with pytest.raises(InvalidTokenizer):
        make_tokenizer("tiktoken")
    with pytest.raises(InvalidTokenizer):
        make_tokenizer("tiktoken", "/nowhere/at.all")


def test_trim_partial():
    assert trim_partial("ا".encode()[-1:] + b"abc" + "€".encode()[:2]) == "abc"
    sample = "نص عربي للتجربة"
    raw = sample.encode()
    for most, overlap in ((7, 2), (5, 0), (3, 1)):
        step = most - overlap
        for i in range(0, len(raw), step):
            assert trim_partial(raw[i : i + most]) in sample
    assert trim_partial(b"a\xffb\x80c") == "a?b?c" and trim_partial(b"\x80\xbfa\xf0\x9f") == "a"  # faults within a slice are replaced
    assert trim_partial(b"") == "" and trim_partial("aé".encode()) == "aé"


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.1]), (2, [0.0, 0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, None, 0.0])], "i int, v array<float>")
    got = {r.i: r.d for r in df.select("i", cosine_distance(F.col("v"), [0.0, 1.0, 0.1]).alias("d")).collect()}
    assert got[1] == pytest.approx(0.9900990099009901, abs=1e-6) and got[2] is got[3] is got[4] is got[5] is None
    assert df.select(cosine_distance(F.col("v"), [0.0, 0.0, 0.0])).first()[0] is None
    names = spark.createDataFrame([(i, v) for i, v in enumerate(["vector(1536)", "VECTOR(768)", "vector", "text", None])], "i int, s string")
    assert [r[0] for r in names.orderBy("i").select(vector_width(F.col("s"))).collect()] == [1536, 768, None, None, None]
    js = spark.createDataFrame([(0, "[1, 2]"), (1, "[1]"), (2, "{}"), (3, None), (4, "x")], "i int, s string")
    assert [r[0] for r in js.orderBy("i").select(parse_vector(F.col("s"), 2)).collect()] == [[1.0, 2.0], None, None, None, None]


def vocabulary_file(path, words):
    import base64

    tokens = [bytes([i]) for i in range(256)] + [w.encode() for w in words]
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(tokens)))
    return str(path)


def test_another_vocabulary_is_another_configuration(spark, tmp_path):
    (tmp_path / "x").mkdir()
    a, b, c = vocabulary_file(tmp_path / "v.tiktoken", ["ab"]), vocabulary_file(tmp_path / "x" / "v.tiktoken", ["ac"]), vocabulary_file(tmp_path / "x" / "w.tiktoken", ["ab"])
    hashes = [configuration_hash(SPEC, EngineConfig(tokenizer="tiktoken", tokenizer_path=p)) for p in (a, b, c, a)]
    assert len(set(hashes)) == 3 and hashes[0] == hashes[3]
    df = spark.createDataFrame([(1, "abac"), (2, None), (3, "")], "k bigint, t string")
    cut = lambda p: [(r.k, r.text) for r in chunks(df, ["k"], "t", EngineConfig(max_tokens=1, overlap=0, tokenizer="tiktoken", tokenizer_path=p)).orderBy("chunk_index").collect()]
    assert cut(a) == [(1, "ab"), (1, "a"), (1, "c")] and cut(b) == [(1, "a"), (1, "b"), (1, "ac")]
    vocabulary_file(tmp_path / "v.tiktoken", ["ac"])  # the same path, another content: loaded anew
    assert cut(a) == cut(b) and configuration_hash(SPEC, EngineConfig(tokenizer="tiktoken", tokenizer_path=a)) == hashes[1]


def test_broadcasts_are_measured(spark):
    from marginalia.runtime import broadcast_if_small

    hinted = lambda df, **most: "ResolvedHint" in broadcast_if_small(df, **most)._jdf.queryExecution().analyzed().toString()
    df = spark.range(50).selectExpr("id", "repeat('x', 1000) AS t", "array(id) AS a")
    assert hinted(df) and not hinted(df, rows=49) and hinted(df, rows=50) and not hinted(df, size=50_000) and hinted(df.limit(0))
