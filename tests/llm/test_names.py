import random

import pytest
from pyspark.sql import functions as F

from weft.llm import linkage, names


def test_fold():
    assert names.fold("Lémanpis　Ｄｉｒａ") == "lemanpis dira"
    assert names.fold("hitоԁі") == "hitodi" and names.fold("Мелсо институт") == "melso institut" and names.fold(None) == ""


def test_parse():
    assert names.parse_person("Aït Doe, Jan F. (99000000001)") == [("doe", ["jan", "f"])]
    assert names.parse_person("Jan F. Doe") == [("doe", ["jan", "f"]), ("jan", ["f", "doe"])]
    assert names.parse_person("") == [("", [])] and names.parse_person("Solo") == [("solo", [])]
    assert names.parse_organisation("Univ. of Soran (USO)") == names.parse_organisation("Université de Soran") == ("university", ["soran"])
    assert names.parse_organisation("Soran Sch. Eng.") == names.parse_organisation("École d'Ingénieurs de Soran")


def slow_near(a, b, most):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1] <= most


def test_near():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in range(2))
        for most in (1, 2):
            assert names.near(a, b, most) == slow_near(a, b, most)


def test_edge_grams_survive_one_error():
    rng = random.Random(9)
    vectors = names.Vectors({}, 1000)
    for _ in range(2000):
        a = "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(6, 14)))
        i = rng.randrange(len(a) - 1)
        for b in (a[:i] + a[i + 1 :], a[:i] + "z" + a[i + 1 :], a[:i] + "z" + a[i:], a[:i] + a[i + 1] + a[i] + a[i + 2 :]):
            assert set(names.edge_grams(a)) & set(names.edge_grams(b)), (a, b)


def test_no_pair_above_the_cosine_without_common_edge_gram():
    """The prefix filter of the sparse join is exact: also anagrams stay below."""
    rng = random.Random(10)
    vectors = names.Vectors({"a": 500, "ab": 100}, 1000)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        b = "".join(rng.sample(a, len(a))) if rng.random() < 0.5 else "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        if not set(names.edge_grams(a)) & set(names.edge_grams(b)):
            assert vectors.cosine(a, b) < names.NAME_COSINE
        assert abs(sum(w * w for w in vectors.of(a).values()) - 1) < 1e-9


def brute_linkage(edges, weights, threshold):
    clusters = [{x} for x in sorted({x for a, b, _ in edges for x in (a, b)})]
    s = {}
    for a, b, v in edges:
        s[a, b] = s[b, a] = v * weights[a] * weights[b]

    def mean(p, q):
        return sum(s.get((x, y), 0.0) for x in p for y in q) / (sum(weights[x] for x in p) * sum(weights[y] for y in q))

    while True:
        best = max(((mean(p, q), i, j) for i, p in enumerate(clusters) for j, q in enumerate(clusters) if i < j), default=(0, 0, 0))
        if best[0] < threshold:
            return sorted(map(sorted, clusters))
        _, i, j = best
        clusters[i] |= clusters.pop(j)


@pytest.mark.parametrize("most, local", [(1, 0), (5, 0), (1, 60), (5, 1000)])
def test_average_linkage_against_brute_force(spark, most, local):
    rng = random.Random(11)
    pairs = {}
    for _ in range(160):
        a, b = sorted(rng.sample(range(60), 2))
        pairs[f"{a:02}", f"{b:02}"] = round(rng.uniform(0.3, 1.0), 9)
    edges = [(a, b, s) for (a, b), s in pairs.items()]
    weights = {f"{i:02}": rng.randint(1, most) for i in range(60)}
    w = spark.createDataFrame(list(weights.items()), "node string, n long")
    got = {}
    for r in linkage.average_linkage(spark.createDataFrame(edges, "a string, b string, s double"), w, 0.45, local).collect():
        got.setdefault(r.cluster, []).append(r.node)
    assert sorted(map(sorted, got.values())) == brute_linkage(edges, weights, 0.45)
    assert all(k == min(v) for k, v in got.items())
    assert linkage.average_linkage(spark.createDataFrame([], "a string, b string, s double"), w, 0.5).count() == 0


def test_hash_is_sparks(spark):
    row = spark.sql("SELECT xxhash64('Aé', 'bcdefghijklmnopqrstuvwxyz0123456789ABC')").first()
    assert linkage._hash("Aé", "bcdefghijklmnopqrstuvwxyz0123456789ABC") == row[0]


PEOPLE = {
    "p1": ["Hidorgakan, Suvel", "Suvel Hidorgakan", "Hidorgakan, S.", "HIDORGAKAN, Suvel", "Hidorgakan, Suvle", "Hidorgaakn, Suvel", "Hídorgakan, Suvel", "Hіdоrgakan, Suvel", "Hidorgakan Suvel"],
    "p2": ["Mopelgeufor, Banbo", "Mopelgeufor, Bani", "Mopelgeufor, B."],
    "p3": ["Mopelgeufor, Zanlu"],
    "p4": ["Ait Tineutor, Reuzi", "Tineutor, Reuzi", "Aittineutor, Reuzi"],
    "p5": ["Lémanpis-Réltikan, Beue", "Lémanpis, Beue"],
}


@pytest.fixture(scope="module")
def mentions(spark):
    rows = [(f"{p}.{i}", n, "") for p, ns in PEOPLE.items() for i, n in enumerate(ns)] + [(f"x{i}", f"Filler{chr(97 + i % 26)}{chr(97 + i // 26)}o, Suvel", "") for i in range(60)]
    rows += [("n1", None, None), ("n2", "", ""), ("n3", "  ", None), (None, "Doe, J", ""), ("p1.0", "Hidorgakan, Suvel", "1"), ("long", "x" * 20000 + ", Y", "")]
    return spark.createDataFrame(rows, "id string, raw string, pid string").withColumn("key", F.lit(1)).withColumn("form", F.lit("x")).withColumn("cluster", F.lit("y"))


def test_people(spark, mentions):
    aliases = spark.createDataFrame([("Bani", "Banbo"), (None, "x"), ("Bani", None)], "alias string, given_name string")
    got = {r.id: r.cluster for r in names.link_people(mentions, "id", "raw", "pid", aliases, "alias", "given_name").collect()}
    assert len(got) == sum(map(len, PEOPLE.values())) + 60 + 4
    groups = {p: {got[f"{p}.{i}"] for i in range(len(ns))} for p, ns in PEOPLE.items()}
    assert all(len(g) == 1 for g in groups.values()), groups
    assert len(set.union(*groups.values())) == len(PEOPLE)
    assert len({got["n1"], got["n2"], got["n3"]}) == 3
    empty = names.link_people(mentions.limit(0), "id", "raw", "pid", aliases.limit(0), "alias", "given_name")
    assert empty.count() == 0


ORGS = {
    "o1": ["Soran University", "University of Soran", "Univ. Soran", "Université de Soran (UNSO)", "SORAN UNIVERSITY", "Unviersity of Soran"],
    "o2": ["Universidad Técnica de Soran", "Technical University of Soran", "Univ. Tecnica Soran"],
    "o3": ["Fandu Institute of Materials", "Inst Materials Fandu", "Institute of Materials Fandu", "Fandu Institute of Mterials"],
    "o4": ["Fandu Institute of Agronomy", "Фанду институт Агрономы"],
    "o5": ["Centre National de Recherche Water Mukeford", "C.N.R. Water Mukeford", "National Research Centre for Water Mukeford"],
}


def test_organisations(spark):
    rows = [(f"{o}.{i}", n) for o, ns in ORGS.items() for i, n in enumerate(ns)] + [("n1", None), ("n2", ""), ("n3", "University"), (None, "x"), ("o1.0", "Soran University")]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("raw", F.lit(1)).withColumn("n", F.lit("z"))
    got = {r.id: r.cluster for r in names.link_organisations(df, "id", "t").collect()}
    groups = {o: {got[f"{o}.{i}"] for i in range(len(ns))} for o, ns in ORGS.items()}
    assert all(len(g) == 1 for g in groups.values()), groups
    assert len(set.union(*groups.values())) == len(ORGS) and len({got["n1"], got["n2"], got["n3"]}) == 3
    assert names.link_organisations(df.limit(0), "id", "t").count() == 0


def test_pairs_within(spark):
    df = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "e")], "cluster string, k string")
    assert [(r.key_a, r.key_b) for r in names.pairs_within(df, "k").collect()] == [("a", "b")]
