import random
from unicodedata import normalize

from hypothesis import given, settings
from hypothesis import strategies as st

from tarmac.llm.decontaminate import Matcher, Pattern, common_form, contaminated, op6_decontaminate, uncontaminated


def least_distance(pattern, text):
    """Edit distance of ``pattern`` to the nearest stretch of ``text``, cell by cell."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row = row, [0]
        for i, p in enumerate(pattern):
            row.append(min(last[i] + (p != c), last[i + 1] + 1, row[i] + 1))
        best = min(best, row[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=90))
def test_myers(pattern, text):
    assert Pattern(pattern).best(text)[0] == least_distance(pattern, text)


def edited(text, n, rng):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + "q" + text[i:], text[:i] + text[i + 1 :], text[:i] + "q" + text[i + 1 :]])
    return text


def test_against_all_distances():
    rng = random.Random(3)
    words = ["on", "er", "that", "inth", "the", "re", "ingat", "ble"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, f := common_form(say(24)), len(f) // 16) for k in range(8)]
    matcher = Matcher(items)
    for _ in range(60):
        k, form, e = rng.choice(items)
        text = common_form(say(30) + " " + edited(form, rng.randrange(0, e + 3), rng) + " " + say(30))
        want = {k: d for k, form, e in items if (d := least_distance(form, text)) <= e}
        got = matcher.found(text)
        assert {k: v[0] for k, v in got.items()} == want


ITEM = "The quick brown fox jumps over the lazy dog, twice, and then once more before it rests."


def test_tables(spark):
    docs = spark.createDataFrame(
        [(1, f"xx {ITEM} yy", 9), (2, ITEM.upper().replace(" ", "!! "), 9), (3, ITEM.replace("jumps", "jumqs"), 9), (4, None, 9), (5, "", 9), (6, "clean text " * 20000, 9), (None, ITEM, 9), (1, f"xx {ITEM} yy", 9), (7, "z " * 50000 + ITEM, 9)],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame([(10, ITEM, 1), (11, None, 1), (12, "", 1), (13, "short", 1), (None, ITEM, 1)], "item_id long, text string, doc_id int")
    for block_chars in (8_000_000, 100):
        got = sorted((str(r.doc_id), str(r.item_id), r.distance) for r in contaminated(docs, items, block_chars=block_chars).collect())
        assert got == sorted((d, i, n) for d, n in [("1", 0), ("1", 0), ("2", 0), ("3", 1), ("None", 0), ("7", 0)] for i in ("10", "None"))
        assert sorted(r.doc_id for r in uncontaminated(docs, items, block_chars=block_chars).collect()) == [4, 5, 6]
    assert contaminated(docs.limit(0), items).count() == 0
    assert contaminated(docs, items.limit(0)).count() == 0


def test_query_finds_all_exact_passages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id): r.distance for r in op6_decontaminate(spark, sf).collect()}
    assert want and {k for k, n in got.items() if n == 0} >= want
    forms = {d.doc_id: common_form(d.text) for d in docs}
    items = {i.item_id: common_form(i.text) for i in items}
    assert all(least_distance(items[i], forms[d]) == n <= len(items[i]) // 16 for (d, i), n in got.items())


FRENCH = "L'été dernier, à la forêt près du château, Élodie a trouvé où le cœur des frères rêvait déjà ; là-bas, même l'âne était très gêné."
GERMAN = "Über die große Straße führt früher oder später für müde Füße ein schöner Weg zurück, den ältere Bäume prächtig säumen und schützen."
SPANISH = "El año pasado, según contó él, ningún niño pidió más atención que la pequeña cigüeña; después cayó la lluvia y también se marchó el ratón."


def test_upper_case_with_accents(spark):
    texts = [FRENCH, GERMAN, SPANISH]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    forms = [lambda t: f"so {t.upper()} on", lambda t: normalize("NFD", t), lambda t: normalize("NFD", t.upper())]
    docs = spark.createDataFrame([(10 * i + k, form(t)) for k, t in enumerate(texts) for i, form in enumerate(forms)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in contaminated(docs, items).collect()) == [(10 * i + k, k, 0) for i in range(3) for k in range(3)]
    assert uncontaminated(docs, items).count() == 0


def test_short_items_are_whole_words_without_edits(spark):
    docs = spark.createDataFrame([(1, "So: who wrote 'Émile'?"), (2, "who wrote emile"), (3, "who wrote Émilette"), (4, "awho wrote Émile"), (5, "WHO  WROTE ÉMILE"), (6, "who wrote Émiles; who wrote Émile")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Who wrote Émile?"), (2, " ?! "), (3, "xyz")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance, r.allowed) for r in contaminated(docs, items).collect()) == [(1, 1, 0, 0), (5, 1, 0, 0), (6, 1, 0, 0)]
    assert sorted(r.doc_id for r in uncontaminated(docs, items).collect()) == [2, 3, 4]


def test_edited_passages_in_tables(spark):
    """Every document against every item, cell by cell; items short and long, edits below, at and above what is allowed."""
    rng = random.Random(9)
    words = ["on", "er", "that", "inth", "the", "re", "ingat", "ble", "Été", "x1"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([3, 6, 9, 12, 16, 24, 40])]
    docs = []
    for d in range(70):
        _, t = rng.choice(items)
        docs.append((d, f"{say(rng.randrange(20))} {edited(t, rng.randrange(len(t) // 16 + 3), rng)} {say(rng.randrange(20))}"))
    forms, want = {i: common_form(t) for i, t in items}, {}
    for d, t in docs:
        for i, f in forms.items():
            text = common_form(t)
            if len(f) < 32:
                if f" {f} " in f" {text} ":
                    want[d, i] = 0
            elif (n := least_distance(f, text)) <= len(f) // 16:
                want[d, i] = n
    d = spark.createDataFrame(docs, "id long, text string")
    b = spark.createDataFrame(items, "id long, text string")
    found = contaminated(d, b, key="id", item_key="id")
    assert found.columns == ["id", "id_", "distance", "allowed", "start", "end"]
    assert {(r.id, r.id_): r.distance for r in found.collect()} == want
    assert {n for n in want.values()} >= {0, 1, 2}
    assert {r.id for r in uncontaminated(d, b, item_key="id").collect()} == {k for k, _ in docs} - {k for k, _ in want}
