"""Names, cross-split overlaps, packing and mixing: brute force, invariants and defined edge cases."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.llm import hashcounts, mixing, names, overlap, packing
from acervo.llm.tokens import with_tokens

GIVEN = frozenset("ana maría luis francisco teresa olga silvia".split())


# --- names ---------------------------------------------------------------------------------------------------------------


def test_near_words_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 11))) for _ in range(120)]
    typos = []
    for w in base[:60]:
        i = rng.randrange(len(w))
        typos += [w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]]
    words = sorted({w for w in base + typos if w})
    got = {tuple(r) for r in names.near_words(spark.createDataFrame([(w,) for w in [*words, *words[:3], "", None]], "word string").repartition(4)).collect()}
    assert got == {(a, b) for a in words for b in words if a == b or (len(a) > 2 and len(b) > 2 and names._edits(a, b, 1) <= 1)}


def test_edits():
    assert [names._edits(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abcd"), ("abc", "xbz"), ("abc", "xyz"))] == [0, 1, 1, 2, 3]


@pytest.mark.parametrize(
    ("name", "parsed"),
    [
        ("Paz Gil, Ana María", (False, "paz", "gil", "ana", "maria")), ("PAZ, A. M.", (False, "paz", "", "a", "m")), ("Ana María Paz", (False, "paz", "", "ana", "maria")), ("Paz, Paco", (False, "paz", "", "francisco", "")),
        ("Dra. Ana Paz", (False, "paz", "", "ana", "")), ("de Paz, Ana", (False, "paz", "", "ana", "")), ("Paz y Gil, Ana", (False, "paz", "gil", "ana", "")), ("Paz A.M.", (False, "paz", "", "a", "m")),
        ("Instituto de Física Aplicada de Morros", (True, "morros", "", "ifa", "")), ("Inst. Física Aplicada Morros", (True, "morros", "", "ifa", "")), ("IFA Morros", (True, "morros", "", "ifa", "")),
        ("Instituto de Física Aplicada (Morros)", (True, "morros", "", "ifa", "")), ("Morros. Instituto de Física Aplicada", (True, "morros", "", "ifa", "")), ("", (False, "", "", "", "")),
    ],
)
def test_parse_name(name, parsed):
    assert names.parse_name(name, frozenset(names.plain(g) for g in GIVEN)) == parsed


def test_link_names(spark):
    same = ["Almarez, Ana María", "ALMAREZ, ANA MARÍA", "Ana María Almarez", "Almraez, Ana María", "Almarez, A. M.", "Almarez, Ana"]
    others = ["Almarez, Luis", "Almarez, Olga", "Boriga, Teresa", "Boriga, T.", "Boriga, Teodoro", "Zudanez, S.", "Instituto de Suelos de Morros", "IS Morros", "Paz, Ana; Gil, Luis", "", "  ", None]
    df = spark.createDataFrame([(n,) for n in [*same, *same, *others]], "name string")
    linked = names.link_names(df, GIVEN)
    pairs = {tuple(r) for r in names.variant_pairs(linked).collect()}
    want = {tuple(sorted(p)) for i, x in enumerate(same) for p in ((x, y) for y in same[i + 1 :])} | {("IS Morros", "Instituto de Suelos de Morros")}
    assert pairs == want  # "Boriga, T." fits two people and is linked to neither
    assert linked.count() == linked.select("name").distinct().count()
    assert names.link_names(df.limit(0), GIVEN).count() == 0


def test_short_surnames_and_further_given_names(spark):
    given = GIVEN | {"luisa", "paula"}
    rows = ["Ruiz, Ana", "Riuz, Ana", "García, Ana María Luisa", "García, Ana María Paula", "Boriga, Pqulina", "Boriga, Aqulina"]
    linked = names.link_names(spark.createDataFrame([(n,) for n in rows], "name string"), given)
    got = {tuple(r) for r in names.variant_pairs(linked).collect()}
    assert got == {("Riuz, Ana", "Ruiz, Ana"), ("Boriga, Aqulina", "Boriga, Pqulina")}


def test_components_of_a_long_chain(spark):
    n = 40
    links = [(i, i + 1) for i in range(n - 1)] + [(100, 101)]
    nodes = spark.createDataFrame([(i,) for i in [*range(n), 100, 101, 200]], "id long")
    edges = spark.createDataFrame([*links, *[(b, a) for a, b in links]], "a long, b long")
    got = {r["id"]: r["comp"] for r in names.components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 100: 100, 101: 100, 200: 200}


# --- overlaps ------------------------------------------------------------------------------------------------------------


def corpus(n=60, seed=4):
    rng = random.Random(seed)
    words = [f"palabra{i}" for i in range(80)]
    rare = lambda: "".join(rng.choice("abdgklmnprst") + rng.choice("aou") for _ in range(5)).capitalize()
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words) if rng.random() > 0.12 else rare() for _ in range(90))
        split = rng.choice(["training", "training", "test", "validation"])
        out.append((f"r{i}", text + ".", split))
        if i % 3 == 0:
            copy = text.split()
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append((f"c{i}", "Título\n\n" + " ".join(copy).replace("l", "1", 3) + ".", rng.choice(["training", "test"])))
    return out


def test_overlaps_equal_brute_force(spark):
    rows = [*corpus(), ("n", None, "test"), ("e", "", "training"), ("b", " \n", "test"), ("s", "hola", None), ("x1", "Un texto corto.", "training"), ("x2", "un texto  corto", "test"), ("x2", "un texto  corto", "test")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "id string, original_text string, split string, content string, size int").repartition(4)
    got = {(r["id_t"], r["id_e"]) for r in overlap.split_overlaps(df).pairs().collect()}
    codes = overlap.Codes()
    sets = {k: (s, set(overlap.shingles(overlap.skeleton(t, {}, codes), 5).tolist())) for k, t, s in rows if t and t.strip() and s}
    want = {(a, b) for a, (s, x) in sets.items() for b, (u, y) in sets.items() if s == "training" and u != "training" and a != b and len(x & y) / len(x | y) >= 0.29}
    assert got == want and ("x1", "x2") in got and len(want) > 5
    assert overlap.split_overlaps(df.limit(0)).pairs().count() == 0


def test_overlap_of_a_text_of_common_words_with_a_damaged_copy(spark):
    """One text has common words alone, its copy ten and more five-word shingles with a name or a damaged word."""
    rng = random.Random(7)
    words = ["".join(rng.choice("bdgmnprs") + rng.choice("aeo") for _ in range(3)) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    copy = texts[0].split()
    for at, other in ((5, "Xantipkwa"), (15, "qwjkpaz"), (25, "Zwatkova"), (45, "kxpdwam")):
        copy[at] = other
    rows = [("a", texts[0], "training"), ("b", "Universidad Kwanpaxi\n" + " ".join(copy), "test"), *[(f"r{i}", t, "training") for i, t in enumerate(texts[1:])]]
    df = spark.createDataFrame(rows, "id string, original_text string, split string")
    assert {(r["id_t"], r["id_e"]) for r in overlap.split_overlaps(df).pairs().collect()} == {("a", "b")}


def test_close_pairs_equal_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 700)
    rows = corpus(90, 11)
    df = spark.createDataFrame(rows, "id string, original_text string, split string").repartition(3)
    codes = overlap.Codes()
    sets = {k: (s, set(overlap.shingles(overlap.skeleton(t, {}, codes), 5).tolist())) for k, t, s in rows}
    want = {(a, b): len(x & y) / len(x | y) for a, (s, x) in sets.items() for b, (u, y) in sets.items() if s == "training" != u and len(x & y) / len(x | y) >= 0.29}
    assert {(r["id_t"], r["id_e"]): r["similarity"] for r in overlap.split_overlaps(df).pairs().collect()} == pytest.approx(want) and len(want) > 5


def test_close_to_equals_brute_force_on_word_changes():
    """Word changes of 1 in 5 to 1 in 20 over texts of few words, so that prefixes meet often."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [[rng.choice(words) for _ in range(rng.randint(3, 120))] for _ in range(150)]
    changed = [[rng.choice(words) if rng.random() < 1 / rng.randint(5, 20) else w for w in t] for t in texts]
    codes = overlap.Codes()
    of = lambda t: overlap.shingles(overlap.skeleton(" ".join(t), {}, codes), 5)
    left, right = [of(t) for t in texts], [of(t) for t in changed]
    held = overlap.Prefixes.build(np.arange(len(left)), left, 0.29)
    for x, got in zip(right, held.close_to(right)):
        want = {k: s for k, y in enumerate(left) if (s := len(np.intersect1d(x, y)) / len(np.union1d(x, y))) >= 0.29}
        assert dict(got) == pytest.approx(want)


def test_index_of_many_blocks_equals_brute_force(spark):
    rows = corpus(90, 12)
    known = overlap.contents(spark.createDataFrame([r for r in rows if r[2] != "training"], "key string, text string, split string"), {}, 5)
    paths = overlap.index(known.unionAll(known).select("content", "shingles"), 0.29, block=700)
    texts = spark.createDataFrame([r[:2] for r in rows if r[2] == "training"], "key string, text string").repartition(3)
    names = {r["content"]: r["key"] for r in known.collect()}
    got = {(r["key"], names[r["content"]]): r["similarity"] for r in overlap.probe(texts, paths, {}, 0.29, 5).collect()}
    codes = overlap.Codes()
    sets = {k: (s, set(overlap.shingles(overlap.skeleton(t, {}, codes), 5).tolist())) for k, t, s in rows}
    want = {(a, b): len(x & y) / len(x | y) for a, (s, x) in sets.items() for b, (u, y) in sets.items() if s == "training" != u and len(x & y) / len(x | y) >= 0.29}
    assert len(paths) > 3 and got == pytest.approx(want) and len(want) > 5


def test_looking_up_a_text_takes_no_longer_among_many_others():
    """Texts that have nothing in common with those asked for cost no time, however many they are."""
    rng = np.random.default_rng(5)
    draw = lambda n: list(np.sort(rng.integers(0, 1 << 62, (n, 6)), axis=1))
    asked = draw(1_000)

    def seconds(n: int) -> float:
        held, took = overlap.Prefixes.build(np.arange(n + 1_000), [*draw(n), *asked], 0.29), []
        for _ in range(3):
            began = time.process_time()
            assert [[p[0] for p in x] for x in held.close_to(asked)] == [[n + i] for i in range(1_000)]
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(1_000_000) < 4 * seconds(1_000)


def test_hot_group_of_copies(spark):
    text = corpus(1)[0][1]
    rows = [(f"t{i}", text, "training") for i in range(40)] + [(f"e{i}", text, "test") for i in range(3)]
    got = overlap.split_overlaps(spark.createDataFrame(rows, "id string, original_text string, split string"))
    assert got.pairs().count() == 120 and got.matches.count() == 40  # one row per training record and content
    counts = got.counts(spark.createDataFrame([(k, "s") for k, _, _ in rows], "id string, source string")).first()
    assert (counts["split"], counts["records"], counts["training_records"], counts["pairs"]) == ("test", 3, 40, 120)


def test_skeleton_survives_damage():
    codes = overlap.Codes()
    sound = overlap.skeleton("La medición del modelo según el glaciar", {}, codes).tolist()
    for damaged in ("La medi-\nción del modelo según el glaciar", "La m e d i c i ó n del MMMOOODDDEEELLLOOO según el g1aciar", "La medicién del modc1o scgún el glaciar".replace("medicién", "medición"), "La mediciÃ³n del modelo segÃºn el glaciar"):
        assert overlap.skeleton(damaged, {}, codes).tolist() == sound, damaged


def test_hash_counts(spark):
    got = hashcounts.counts_of(spark.createDataFrame([(1,), (1,), (1 + (1 << 22),), (None,), (9,)], "h long"))
    assert got[1] == 3 and got[9] == 1 and got.sum() == 4


# --- packing -------------------------------------------------------------------------------------------------------------

tokenizer = pytest.mark.skipif(not __import__("os").path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"), reason="no tokenizer files")


@tokenizer
def test_pack_keeps_every_token(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["agua", "suelo", "roca", "poema", "verso"]) for _ in range(rng.choice([3, 20, 60, 150]))), "c") for i in range(300)]
    rows += [(900, "palabra " * 2000, "c"), (901, None, "c"), (902, "", "c"), (0, rows[0][1], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string").repartition(3)
    packed = packing.pack(df, {"s": 64, "l": 512}, shard=50)
    sizes = with_tokens(df, "text").groupBy("doc_id").agg(F.sum("tokens").alias("n"))
    for budget, capacity in (("s", 64), ("l", 512)):
        mine = packed.where(F.col("budget") == budget)
        assert mine.groupBy("container").agg(F.sum("tokens").alias("n")).agg(F.max("n")).first()[0] <= capacity
        placed = {r["doc_id"]: r["n"] for r in mine.groupBy("doc_id").agg(F.sum("tokens").alias("n")).collect()}
        assert placed == {r["doc_id"]: r["n"] for r in sizes.collect() if r["n"]}
        split = {r["doc_id"] for r in mine.groupBy("doc_id").agg(F.max("piece").alias("p")).where("p > 0").collect()}
        assert split == {r["doc_id"] for r in with_tokens(df, "text").where(F.col("tokens") > capacity).collect()}
    rates = {r["budget"]: r["fill"] for r in packing.fill_rates(packed, {"s": 64, "l": 512}).collect()}
    assert all(v > 0.85 for v in rates.values()), rates
    assert packing.pack(df.limit(0), {"s": 64}).count() == 0


def test_index_equals_brute_force_bm25():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["agua", "suelo", "roca", "poema", "verso", "cuenca"]) for _ in range(rng.randint(3, 12))) for _ in range(25)]
    index = packing.Index(texts)
    for i in range(5):
        got = index.neighbours(i)
        scores = np.zeros(len(texts))
        mean = sum(len(t.split()) for t in texts) / len(texts)
        for w in set(texts[i].split()):
            df = sum(w in t.split() for t in texts)
            idf = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
            for j, t in enumerate(texts):
                n, size = t.split().count(w), len(t.split())
                scores[j] += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean))
        scores[i] = 0
        assert np.allclose(np.sort(scores[got])[::-1], scores[got]) and set(got) == set(np.flatnonzero(scores))


# --- mixing --------------------------------------------------------------------------------------------------------------


@tokenizer
def test_mix_reaches_shares_within_caps(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["palabra"] * rng.randint(20, 60)), s) for i, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 20)]
    rows += [(5000 + i, "palabra palabra", None) for i in range(5)] + [(6000, None, "a"), (6001, "", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, tokens_used int")
    targets = spark.createDataFrame([("m", "a", 0.5, 1, 0.3), ("m", "b", 0.5, 2, 0.3), ("k", "b", 0.2, 1, 0.2), ("k", "c", 0.8, 3, 0.2)], "mix string, source string, target_share double, max_repeats int, total_ratio double")
    mixture = mixing.mix(df, targets)
    mixed = mixture.selection
    assert mixed.where("uses < 1").count() == 0 and mixed.groupBy("mix", "doc_id").count().where("count > 1").count() == 0
    got = {(r["mix"], r["source"]): r for r in mixing.reached_shares(mixture, targets).collect()}
    assert abs(got["m", "a"]["share"] - 0.5) < 0.02 and abs(got["m", "b"]["share"] - 0.5) < 0.02
    assert got["k", "c"]["most_uses"] == 3 and got["k", "c"]["texts"] == 20 and got["k", "b"]["most_uses"] <= 1
    assert mixing.mix(df.limit(0), targets).selection.count() == 0
    assert mixing.mix(df, targets.limit(0)).selection.count() == 0


@tokenizer
def test_mix_with_a_third_of_the_labels_removed(spark):
    """Sources with words of their own: posteriors stand in for the labels, and shares by the true source come out."""
    rng = random.Random(5)
    own = {"a": [f"alfa{i}x" for i in range(30)], "b": [f"beta{i}x" for i in range(30)], "c": [f"gama{i}x" for i in range(30)]}
    words = lambda s: " ".join(rng.choice(own[s]) for _ in range(40)).translate(str.maketrans("0123456789", "qwertyuiop"))
    true = {i: s for i, s in enumerate("a" * 500 + "b" * 300 + "c" * 100)}
    rows = [(i, words(s), None if i % 3 == 0 else s) for i, s in true.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 0.4, 1, 0.5), ("m", "b", 0.3, 2, 0.5), ("m", "c", 0.3, 3, 0.5)], "mix string, source string, target_share double, max_repeats int, total_ratio double")
    mixture = mixing.mix(df, targets)
    used = {}
    for r in mixture.selection.collect():
        used[true[r["doc_id"]]] = used.get(true[r["doc_id"]], 0) + r["tokens"] * r["uses"]
    total = sum(used.values())
    assert all(abs(used[s] / total - share) < 0.02 for s, share in (("a", 0.4), ("b", 0.3), ("c", 0.3)))
    told = mixing.reached_shares(mixture, targets).collect()
    assert all(r["settled"] and abs(r["share"] - r["target_share"]) < 0.02 and abs(r["posterior_share"] - r["target_share"]) < 0.02 for r in told)


def test_rates_match_targets(spark):
    groups = spark.createDataFrame([(1, "a", {"a": 1.0}, 1000.0), (2, "b", {"b": 1.0}, 500.0), (3, "a", {"a": 0.5, "b": 0.5}, 400.0), (4, "z", {"a": 1.0}, 50.0)], "group long, source string, weights map<string,double>, tokens double")
    fit = mixing.rates(groups, {"a": 600.0, "b": 600.0}, {"a": 1.0, "b": 3.0})
    got = {r["group"]: r["rate"] for r in fit.rates.collect()}
    assert abs(1000 * got[1] + 400 * got[3] - 600) < 5 and abs(500 * got[2] - 600) < 5  # shares by label are kept
    assert got[3] < 0.05 and got[1] <= 1 and 4 not in got and fit.settled and fit.error < 0.05  # and those by posteriors come nearest
    short = mixing.rates(groups, {"a": 600.0, "b": 3000.0}, {"a": 1.0, "b": 2.0})
    assert {r["group"]: r["rate"] for r in short.rates.collect()}[2] == 2.0  # the cap holds
