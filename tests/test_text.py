"""Row-level rules with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from kgweave.functions import text as X
from kgweave.operators import answers as A
from kgweave.operators import budget as B
from kgweave.operators import lines as L
from kgweave.operators import records as R
from kgweave.operators import resolve as V
from kgweave.providers import Offline, Routed, complete, hashed_vector


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "name, targets",
    [
        ("viêm gan", ["VIÊM GAN"]),
        ("ENTITY: x", []),
        ("12/34-56 a", []),
        ("12", []),
        ("ab", ["AB"]),
        ("e", ["E"]),
        ("q", []),
        ("**viêm** [gan]", ["VIÊM GAN"]),
        ("paracetamol 500 mg", ["PARACETAMOL500MG"]),
        ("CO₂", ["CO2"]),
        ("đau đau bụng", ["ĐAU BỤNG"]),
        ("sốt 38 độ c", ["SỐT38 °C"]),
        ("x" * 70, ["X" * 70]),
        ("uống thuốc " + "x" * 70, []),
        (", ".join(f"bệnh số {c * 12}" for c in "abcdefgh"), [f"BỆNH SỐ {c * 12}".upper() for c in "abcdefgh"]),
    ],
)
def test_targets(spark, name, targets):
    assert one(spark, name, R.targets) == targets


def test_null_rules(spark):
    assert one(spark, None, R.cleaned) is None
    assert one(spark, None, X.day) is None
    assert one(spark, "", X.markdown_quality) == 0.0


def test_records(spark):
    raw = '("entity"<|>GAN_A <|> type<|>d (x y))####("relationship"<|>a<|>b<|>c<|>8.5)##("relationship"<|>a<|>b<|>c<|>strong)##("entity"<|>two<|>fields)##("entity"<|>only)'
    df = spark.createDataFrame([(1, raw)], "id int, raw string")
    assert [tuple(r) for r in R.parsed_entities(df).collect()] == [(1, "GAN A", "TYPE", "d (x y")]
    assert [r["weight"] for r in R.parsed_relationships(df).collect()] == [85, 1]
    assert [r["weight"] for r in R.parsed_relationships(df, strict_weight=True).collect()] == [10, 1]


def test_signature(spark):
    assert one(spark, "VIÊM GAN B TYP 2 TRÁI", V.signature) == "2|B|GAN|TRÁI"
    assert one(spark, "ĐAU", V.signature) == ""


def test_expansion(spark):
    assert one(spark, "HC và HCC", lambda c: R.expanded(c, [("HC", "hội chứng"), ("HCC", "ung thư gan")])) == "hội chứng và ung thư gan"
    assert one(spark, "hc", lambda c: R.expanded(c, [("HC", "hội chứng")], whole=True)) == "hội chứng"


@pytest.mark.parametrize("raw, day", [("ngày 05/03/2024", "2024-03-05"), ("2024-03-05", "2024-03-05"), ("31/02/2024", None), ("Error", None)])
def test_day(spark, raw, day):
    assert one(spark, raw, lambda c: X.day(c).cast("string")) == day


def test_files(spark):
    assert one(spark, "https://a/b/t%C3%AAn+1.pdf", X.url_file) == "tên+1"
    assert one(spark, "Viêm gan: B, C!", X.slug) == "viêm_gan_b_c"
    assert one(spark, "https://a/b/c", X.parent_url) == "https://a/b"


def test_headings(spark):
    text = "I. ĐẠI CƯƠNG\n1. Khái niệm\n2. ĐIỀU TRỊ\nPHỤ LỤC\n1. CHUNG\nabc"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [r["level"] for r in L.levelled(L.lines(df)).orderBy("pos").collect()] == [2, 0, 1, 1, 1, 0]
    assert [r["context"] for r in L.with_headers(L.lines(df)).orderBy("pos").collect()][-1] == "1. CHUNG"
    assert L.normalised(df).first()["text"].startswith("## I. ĐẠI CƯƠNG\n1. Khái niệm\n# 2.")


def test_merge_model(spark):
    import random

    rng = random.Random(2)
    rows = [(f, i, f"c{i}", rng.choice([50, 150, 250, 900])) for f in "abcde" for i in range(30)]

    def model():
        out, acc = [], None
        for f, p, c, t in rows:
            if acc is None or acc[0] != f or not (t < 200 or acc[3] < 200):
                if acc:
                    out.append(tuple(acc))
                acc = [f, p, c, t, 1]
            else:
                acc = [f, acc[1], acc[2] + "\n" + c, acc[3] + t, acc[4] + 1]
        return sorted(out + [tuple(acc)])

    got = B.merged_small(spark.createDataFrame(rows, "file string, pos int, content string, tokens int"))
    assert sorted(tuple(r) for r in got.collect()) == model()


def test_packing(spark):
    df = spark.createDataFrame([(i, 100 * (i % 40)) for i in range(200)], "id bigint, tokens int")
    rows = B.packed(df, 3500).collect()
    assert {r["id"] for r in rows} == {i for i in range(200) if 100 * (i % 40) <= 3500}
    used = {}
    for r in rows:
        used[r["bin"]] = used.get(r["bin"], 0) + r["tokens"]
    assert max(used.values()) <= 3500 and sorted(used) == list(range(1, len(used) + 1))


def test_split():
    size = lambda s: len(s.split())
    text = "\n\n".join(" ".join(f"w{p}_{i}" for i in range(40)) + "." for p in range(5))
    pieces = B.split_text(text, size, 50, 10)
    assert all(size(p) <= 50 for p in pieces) and {w for p in pieces for w in p.split()} == set(text.split())
    assert B.split_text("", size, 5) == [] and B.split_text("a b", size, 5) == ["a b"]


def test_points(spark):
    raw = 'x ```json\n{"points": [{"description": "a", "score": 7.5}, {"description": "b", "score": 0}, {"score": 3}]}\n```'
    assert [(p["description"], p["score"]) for p in one(spark, raw, A.parsed_points)] == [("a", 7.5)]
    assert one(spark, "no json", A.parsed_points) == []


def test_global(spark):
    reports = spark.createDataFrame([(i, f"dòng {i} đau ngực\nkhác", 100) for i in range(60)], "id bigint, text string, tokens int")
    assert "đau ngực" in A.ask_global(spark, reports, "đau ngực là gì")
    with pytest.raises(ValueError):
        A.ask_global(spark, reports, "  ")
    assert A.ask_global(spark, reports, "zzz") == A.REFUSAL


def test_providers(spark):
    def broken(prompts):
        raise RuntimeError("down")

    routed = Routed([broken, Offline(str.upper)])
    assert routed(["a"]) == ["A"] and routed.failed == {0: 1}
    df = spark.createDataFrame([("a",), ("b",)], "p string")
    assert [r["o"] for r in complete(df, "p", "o", broken).collect()] == [None, None]
    assert len(hashed_vector("xin chào")) == 64


def test_fuzzy_pairs_brute(spark):
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("ABCDEFGH") for _ in range(rng.randrange(12, 40))) for _ in range(25)]
    names = sorted({b[:4] + "".join(rng.choice("XYZ") if rng.random() < 0.05 else c for c in b[4:]) for b in base for _ in range(6)} | {"", "AB"})

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for a in names for b in names if a < b and a and a[:4] == b[:4] and dist(a, b) <= max(len(a), len(b)) * 10 // 100}
    got = V.fuzzy_pairs(spark.createDataFrame([(n, n) for n in names], "name string, text string"))
    assert {(r["a"], r["b"]) for r in got.collect()} == want and want


def test_output_checks(spark):
    from kgweave.operators import model_steps as M

    long = "một câu dài hơn sáu mươi ký tự để kiểm tra phần cuối của văn bản này"
    cases = {"Xin lỗi, tôi không thể trả lời": True, "As an AI": True, "bình thường": False, None: False}
    for text, want in cases.items():
        assert one(spark, text, M.is_refusal) == want
    for text, reason, want in (("ngắn", "length", True), ("ngắn", "stop", False), (long + ".", "stop", False), (long + " và", "stop", True), (long + " (abc", "stop", True), (long, "stop", False), (None, None, False), ("x" * 200, "stop", True)):
        assert one(spark, text, lambda c, r=reason: M.is_broken_off(c, F.lit(r), F.lit(0))) == want, text
    assert one(spark, '{"title": "a"}', lambda c: M.read_report(c).isNull())
    assert one(spark, 'x {"title": "a", "findings": []} y', lambda c: M.read_report(c)["title"]) == "a"


def test_model_steps(spark):
    from kgweave.operators import model_steps as M
    from kgweave.operators import retrieval

    chunks = spark.createDataFrame([("c1", "Có 7 trường hợp đau ngực liên quan đến van tim. Hết."), ("c2", "")], "chunk_id string, content string")
    assert [r["name"] for r in R.parsed_entities(M.extracted(chunks).select("chunk_id", "raw")).orderBy("name").collect()] == ["VAN TIM", "ĐAU NGỰC"]
    again = M.extracted(chunks, check=Offline(lambda p: "YES" if "ĐAU" in p else "NO"), more=Offline(lambda p: '("entity"<|>X<|>T<|>d)')).collect()
    assert {r["chunk_id"]: "<|>X<|>" in r["raw"] for r in again} == {"c1": True, "c2": False}
    items = spark.createDataFrame([(1, ["b", "a", "b "]), (2, ["x"]), (3, None)], "id bigint, items array<string>")
    assert {r["id"]: r["text"] for r in M.consolidated(items).collect()} == {1: "a; b", 2: "x", 3: None}
    v = spark.createDataFrame([(i, hashed_vector(f"đau ngực {i}", 16)) for i in range(9)], "id bigint, embedding array<double>")
    links = spark.createDataFrame([(i, (i + 1) % 9, 5) for i in range(9)], "x bigint, y bigint, w bigint")
    text = M.ask_local(spark, v, v.select("id", F.concat(F.lit("V"), F.col("id").cast("string")).alias("name")), lambda centres: links, "đau ngực 3")
    assert text.startswith("=== [1] V3") and retrieval.hybrid
    with pytest.raises(ValueError):
        M.ask_local(spark, v, v, lambda c: links, " ")


def test_no_leak(spark):
    names = ["VIÊM {GAN}", "a<|>b", "ENTITY x", "KEYWORD", "x; y", "GAN"]
    df = R.audit(spark.createDataFrame([(n,) for n in names], "name string"))
    assert {r["name"]: r["status"] for r in df.collect()} == {"VIÊM {GAN}": "SUCCESS_RECOVERY", "a<|>b": "FAILED_LEAK", "ENTITY x": "SUCCESS_DROP_NOISE", "KEYWORD": "FAILED_LEAK", "x; y": "FAILED_LEAK", "GAN": "CLEAN"}


def test_prefix_keeps_rows_of_no_size(spark):
    """Blank rows use nothing up: the cut by rank, which is there for hot keys, takes none of them away."""
    from kgweave.operators.budget import prefix

    rows = [("k", i, 0) for i in range(10)] + [("k", 10, 1), ("k", 11, 5), ("k", 12, 0)]
    df = spark.createDataFrame(rows, "key string, o int, size int")
    whole = prefix(df, "key", ["o"], F.col("size"), 5).collect()
    assert sorted(whole) == sorted(prefix(df, "key", ["o"], F.col("size"), 5, most_rows=5).collect()) and len(whole) == 11


def test_hot_keys_join_on_their_own(spark):
    from kgweave.session import join_hot

    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), ("b", 2), ("gone", 3), (None, 4)], "k string, n int")
    right = spark.createDataFrame([("hot", "H"), ("a", "A"), ("b", "B"), ("other", "O")], "k string, v string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, join_hot(left, right, "k", how, heavy_rows=10).select("k", "n", "v").collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, "k", how).select("k", "n", "v").collect()), key=str)


def test_failed_batches_are_told(spark):
    from kgweave.providers import complete

    def provider(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    got = {r["p"]: (r["a"], r["e"]) for r in complete(spark.createDataFrame([("x",), ("bad",)], "p string").coalesce(1), "p", "a", provider, batch=1, error="e").collect()}
    assert got == {"x": ("X", None), "bad": (None, "ValueError: no")}


def test_wrapped_answers(spark):
    from kgweave.functions.text import model_text, unwrapped

    rows = [('{"answer": "gan"}', "gan"), ('{"a": "1", "b": "2"}', '{"a": "1", "b": "2"}'), ("gan", "gan"), (None, None), ("{bad", "{bad"), ("Dưới đây là câu trả lời:\ngan", "gan")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r[0] for r in df.select(unwrapped(model_text(F.col("t")))).collect()] == [b for _, b in rows]


def test_keys_take_turns():
    from kgweave.providers import Keyed

    seen = []

    def call(key, prompts):
        seen.append(key)
        if key == "bad":
            raise ValueError("refused")
        return [key + p for p in prompts]

    keyed = Keyed(call, ["a", "bad", "c"], wait=(0.0,))
    assert [keyed(["x"]) for _ in range(3)] == [["ax"], ["cx"], ["ax"]] and seen == ["a", "bad", "c", "a"]
    with pytest.raises(ValueError):
        Keyed(call, ["bad"], wait=(0.0,))(["x"])


def test_runs_of_small_chunks_fold_apart(spark):
    """Against a fold in one go, on random sizes around the threshold."""
    import random

    rng = random.Random(8)
    rows = [(f, p, f"{f}{p}", rng.choice([5, 60, 199, 200, 300])) for f in "ab" for p in range(200)]
    want = []
    for f, p, c, t in rows:
        if want and want[-1][0] == f and (t < 200 or want[-1][3] < 200):
            want[-1][2] += "\n" + c
            want[-1][3] += t
        else:
            want.append([f, p, c, t])
    got = B.merged_small(spark.createDataFrame(rows, "file string, pos int, content string, tokens int").repartition(5)).select("file", "pos", "content", "tokens").collect()
    assert sorted(map(list, got)) == sorted(want)
