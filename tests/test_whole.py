"""Queries over small tables of their own: no row, word or mark is left out."""

import re
import unicodedata

from kgweave.operators.resolve import CRITICAL, ROMAN
from kgweave.plans import evaluation, graph_analytics, resolution, search


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_names_keep_marks(spark, tmp_path):
    names = ["Viêm phổi thùy dưới bên TRÁI", "Viêm phổi thùy dưới bên PHẢI", "Viêm phổi thùy dưới bên trai", "Suy thận CẤP ở người cao tuổi có bệnh nền", "Suy thận MẠN ở người cao tuổi có bệnh nền", "Suy thận cấp ở người cao tuổi có bệnh nên"]
    names += ["SUY  THẬN MẠN Ở NGƯỜI CAO TUỔI-CÓ BỆNH NỀN", "Viêm phổi thùy dưới bên phải.", unicodedata.normalize("NFD", "Viêm phổi thùy dươi bên TRÁI"), "Tổn thương mạn tính", "Tổn thương man tính", "", None]
    sf = written(spark, tmp_path, "nodes", [(n,) for n in names], "entity_name string")
    upper = sorted({" ".join(unicodedata.normalize("NFC", n).upper().split()) for n in names if n})
    rules = [r"\d+", r"\b[A-Z]\b", rf"\b(?:{ROMAN})\b", rf"\b(?:{CRITICAL})\b"]
    marks = {n: {x for r in rules for x in re.findall(r, n)} for n in upper}
    text = {n: re.sub("[^A-Z0-9À-Ỹ]", "", n) for n in upper}
    block = {n: re.sub("[^A-Z0-9]", "", n)[:4] for n in upper}
    want = {(a, b) for a in upper for b in upper if a < b and block[a] == block[b] and marks[a] == marks[b] and distance(text[a], text[b]) * 10 <= max(len(text[a]), len(text[b]))}
    assert {(r["a"], r["b"]) for r in resolution.fuzzy_pairs(spark, sf).collect()} == want and want
    label = {r["v"]: r["component"] for r in resolution.fuzzy_components(spark, sf).collect()}
    assert set(label) == {x for p in want for x in p} and all(label[a] == label[b] for a, b in want)
    assert not any("TRÁI" in a and "PHẢI" in b or "CẤP" in a and "MẠN" in b for a in label for b in label if label[a] == label[b])
    for query, column in ((resolution.medoid_names, "medoid"), (resolution.shortest_names, "name")):
        assert {r["component"]: label[r[column]] for r in query(spark, sf).collect()} == {c: c for c in label.values()}


def test_structural_clean_joins_numbers(spark, tmp_path):
    names = {"vitamin b 12": "VITAMIN B12", "B \t 6": "B6", "Covid 19 [nặng]": "COVID19 NẶNG", "độ 3": "ĐỘ 3", "12 A": "12 A", "viêm  gan": "VIÊM GAN"}
    sf = written(spark, tmp_path, "nodes", [(n,) for n in [*names, None, "12 A"]], "entity_name string")
    assert [tuple(r) for r in resolution.structural_clean(spark, sf).orderBy("name").collect()] == sorted(names.items())


def test_graph_takes_weak_edges(spark, tmp_path):
    edges = [("a", "b", 1.0), ("B ", "c", 2.0), ("c", "d", 0.5), ("d", "e", 3.0), ("x", "y", 1.0), ("x", "z", 20.0), ("a", "a2", 1.0), ("a", "a3", 1.0), ("a", "a", 9.0), (None, "q", 9.0)]
    sf = written(spark, tmp_path, "edges", edges, "source string, target string, weight double")
    assert {r["v"]: r["component"] for r in graph_analytics.component_labels(spark, sf).collect()} == {v: "A" for v in ("A", "A2", "A3", "B", "C", "D", "E")} | {v: "X" for v in "XYZ"}
    assert {r["v"]: r["hops"] for r in graph_analytics.ego_graph(spark, sf).collect()} == {"A": 0, "A2": 1, "A3": 1, "B": 1, "C": 2}
    rows = graph_analytics.community_hierarchy(spark, sf).collect()
    assert {r["v"] for r in rows if r["level"] == 0} == {"A", "A2", "A3", "B", "C", "D", "E", "X", "Y", "Z"}
    assert {r["n_vertices"] for r in graph_analytics.community_levels(spark, sf).collect()} == {10}


def test_every_event_counts(spark, tmp_path):
    sf = written(spark, tmp_path, "events", [(i, i % 4, "click" if i % 2 else "view") for i in range(1, 13)], "event_id bigint, user_id bigint, event_type string")
    got = {r["user_id"]: (r["types"], r["n"]) for r in evaluation.points_context(spark, sf).collect()}
    assert got == {0: ('["view"]', 3), 1: ('["click"]', 3), 2: ('["view"]', 3), 3: ('["click"]', 3)}
    assert evaluation._judged(spark, sf).count() == 12
    assert {r["grp"]: r["n"] for r in evaluation.judge_summary(spark, sf).collect()} == {"A": 4, "B": 4}
    rows = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, None, 2.0, 3.0), (3, 1.0, float("nan"), 3.0)], "id bigint, faithfulness double, relevance double, comprehensiveness double")
    assert [r["id"] for r in evaluation.scored(rows).collect()] == [1]


def test_every_name_is_expanded(spark, tmp_path):
    names = {"viêm gan ở BN": "viêm gan ở bệnh nhân", "Điều trị HC": "Điều trị hội chứng", "XN": "xét nghiệm", "HCC gan": "ung thư gan gan", "đau ngực": "đau ngực"}
    sf = written(spark, tmp_path, "nodes", [(n,) for n in [*names, None]], "entity_name string")
    assert {r["name"]: r["expanded"] for r in resolution.abbreviation_expansion(spark, sf).collect()} == names


def test_points_are_whole_lines(spark, tmp_path):
    texts = {5: "một hai ba\n\n" + "dài " * 300 + "\nba", 10: "x " * 4000 + "\ny z", 1: "a\n" + "b " * 11000, 2: None}
    sf = written(spark, tmp_path, "documents", [(i, f"t{i}", t) for i, t in texts.items()], "doc_id bigint, title string, text string")
    want = []
    for level in (0, 1):
        points = sorted((-(len(x.split()) * 13 // 10), f"{i} {x}") for i, t in texts.items() if t and i % 5 == level for x in t.split("\n") if x.strip())
        total = 0
        for k, (score, text) in enumerate(points, 1):
            total += len(f"#{k} ({-score})\n{text}\n\n")
            if total <= 21_000:
                want.append((level, k, float(-score), total))
    assert sorted(tuple(r) for r in search.reduce_context_prefix(spark, sf).collect()) == want and {w[0] for w in want} == {0} and want[0][3] > 8000


def test_label_stars_by_cosine(spark, tmp_path):
    labels = ["bệnh tim mạch nội khoa", "ung thư", "nội khoa tim mạch bệnh", "bệnh da liễu", None]
    sf = written(spark, tmp_path, "subjects", list(enumerate(labels)), "subject int, label_vi string")
    assert [tuple(r) for r in resolution.label_stars(spark, sf).collect()] == [(labels[0], f"{labels[0]}, {labels[2]}")]
    near = resolution.label_stars(spark, sf, embed=lambda x: [1.0, float("ung" in x)], least=0.7).collect()
    assert [r["head"] for r in near] == ["ung thư"]
