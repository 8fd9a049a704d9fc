import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rainloom.llm import bpe, chat, common, decontaminate, langid, pii, quality
from rainloom.llm.queries import RANKS

KEY = "a key of the tests"
PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(encoding, i, text):
    ids = encoding.encode_ordinary(text or "")
    return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def test_bpe_is_the_library_s(documents, odd, encoding):
    for df, chunk, overlap in ((documents, 400, 60), (odd, 1_000, 100), (odd, bpe.CHUNK, bpe.OVERLAP)):
        want = [digest(encoding, r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = [tuple(r) for r in bpe.round_trips(df, PATH, PATTERN, chunk, overlap).collect()]
        assert order(got) == order(want)


def test_bpe_empty_table_and_values(empty, spark, encoding):
    assert bpe.round_trips(empty, PATH, PATTERN).collect() == []
    row = bpe.encode(spark.createDataFrame([(1, "Hello  world")], "doc_id long, text string"), PATH, PATTERN).first()
    assert list(row.ids) == encoding.encode_ordinary("Hello  world") and bytes(row.decoded) == b"Hello  world"


def test_bpe_goes_on_after_long_pre_tokens(spark, encoding, monkeypatch):
    """Pre-tokens longer than the overlap, runs of digits out of phase and long white space: the library's ids, in pieces that stay small."""
    words = "some plain words in a row, 12 of them. " * 60
    texts = [
        words + "x" * 700 + " " + words,
        words + "9" * 4_001 + " " + words,
        words + " " * 900 + words + "y" * 5_000 + " " + words,
        "z" * 9_000,
        " ".join("w" * 150 for _ in range(80)) + words,
        words + "".join("é🙂ab" for _ in range(1_000)) + words,
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    got = [tuple(r) for r in bpe.round_trips(df, PATH, PATTERN, 400, 60).collect()]
    assert order(got) == order([digest(encoding, r.doc_id, r.text) for r in df.collect()])
    sizes = []
    whole = bpe._cut_pieces

    def seen(*args):
        cut = whole(*args)
        sizes.extend(cut.select(F.length("piece")).toPandas().iloc[:, 0])
        return cut

    monkeypatch.setattr(bpe, "_cut_pieces", seen)
    text = words + "x" * 300 + " " + words * 20
    assert bpe.round_trips(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, PATTERN, 400, 60).count() == 1
    # One turn more, with an overlap of 480 and chunks of 1,920: no piece is longer than a chunk and its overlap.
    assert sum(sizes) == len(text) and max(sizes) <= 1_920 + 480


def test_stitch_stops_where_agreement_ends():
    import numpy as np

    a = lambda *x: np.array(x, np.int64)
    assert bpe.stitch([(1, a(10, 12), a()), (0, a(), a(12))]) == [0, 12]
    assert bpe.stitch([(0, a(), a(11)), (1, a(12), a(20)), (2, a(20), a())]) == [0]


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a <turn:x> </turn>\n \\s \\l \\ <part>"),
        (1, 1, "user", ""),
        (1, 2, "assistant", "\\### Assistant: </turn> ok\\"),
        (1, 3, "assistant", None),
        (1, 4, None, "🙂 é"),
        (1, None, "sy>s\\g", "first"),
        (2, 1, "assistant", "b"),
        (2, 1, "assistant", "b"),
        (None, 0, "user", "q"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df)
    back = out.select("conv_id", "formatted", chat.parse_formatted(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in back.collect()}
    assert [(t.role, t.text) for t in got[1].t] == [("sy>s\\g", "first"), ("user", rows[0][3]), ("user", ""), ("assistant", rows[2][3]), ("assistant", ""), ("", "🙂 é")]
    assert got[1].loss == rows[2][3] and got[2].loss == "bb" and got[None].loss == ""
    assert got[1].formatted.count("<part>") == 2
    assert chat.format_conversations(df.filter("false")).collect() == []


def test_chat_long_conversations(spark):
    """Many turns, over several runs of places, and a very long text; equal to plain Python, and the spans agree with the bytes."""
    n = 20 * chat.RUN + 3
    said = [(k, ("user", "assistant", "assistant")[k % 3], f"turn {k} é🙂 <\\ " * (k % 4)) for k in range(n)] + [(n, "assistant", "x<" * 300_000)]
    rows = [(1, *r) for r in reversed(said)] + [(2, 0, "user", "only")] + [(3, 0, "assistant", "same")] * 2
    done = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    back = {r.conv_id: r for r in done.select("*", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [r[1:] for r in said]
    assert back[1].loss == "".join(t for _, role, t in said if role == "assistant")
    raw = back[1].formatted.encode()
    for s in back[1].loss_spans:
        assert raw[s.first_byte : s.first_byte + s.bytes].decode() == back[1].formatted[s.start : s.start + s.size]
    assert back[2].loss == "" and back[3].loss == "samesame" and back[3].formatted == "<turn:assistant>same<part>same</turn>\n"


def test_language_held_out_accuracy(documents, odd, empty):
    found = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    odd_found = {r.doc_id: r.lang_pred for r in langid.identify(odd).collect()}
    assert odd_found[1] == odd_found[2] == odd_found[3] == "und" and odd_found[8] == "en"
    assert langid.identify(empty).collect() == []
    kept = langid.accepted(documents)
    assert kept.columns == documents.columns and kept.count() >= 0.99 * documents.count()


def test_language_filter_names_all_languages(spark):
    import numpy as np

    # 70 languages, so that masks have two words; grams of every sign.
    names = [f"l{k:02}" for k in range(70)]
    grams = {0x123456789ABCDEF0: {0, 1, 69}, -0x3456789ABCDEF123: {1}, 0x56789ABCDEF12345: set(range(70)), -0x789ABCDEF1234567: {63, 64}}
    model = langid.Filter.of(names, spark.createDataFrame([(names[k], g) for g, ks in grams.items() for k in ks], "lang string, gram long"))
    for g, ks in grams.items():
        at = langid.probes(np.array([g], np.int64).view(np.uint64))
        masks = [int(np.bitwise_and.reduce([model.slots[w, p] for p in at])[0]) for w in range(2)]
        assert {k for k in range(70) if masks[k // 64] >> (k % 64) & 1} == ks


def test_language_counts_against_brute_force(spark, documents):
    """Masks name every language whose learned text has the n-gram often enough, and corrected counts are those of plain sets."""
    import collections
    import math

    import numpy as np

    rows = [(r.lang, r.text) for r in documents.filter("text IS NOT NULL AND lang IS NOT NULL").orderBy("doc_id").limit(300).collect()]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"), sample=10_000)

    seen = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        seen[lang].update(int(h) for part, _ in langid.grams([text]) for h in part)
    sets = {x: {g for g, n in c.items() if n / c.total() >= langid.MIN_SHARE} for x, c in seen.items()}
    assert model.languages == sorted(sets)
    texts = [t for _, t in rows[:60]]
    total, hits, weighed = model.counts(texts)
    for i, text in enumerate(texts):
        found = [int(h) for part, _ in langid.grams([text]) for h in part]
        assert total[i] == len(found)
        for k, lang in enumerate(model.languages):
            own = [g for g in found if g in sets[lang]]
            assert abs(hits[i, k] - len(own)) <= 1 + 0.002 * len(found)
            want = sum(math.log2((len(sets) + 1) / sum(g in s for s in sets.values())) for g in own)
            assert abs(weighed[i, k] - want) <= 3 + 0.01 * len(found)
    assert np.all(model.false_positive < 0.01)


def test_quality_held_out(spark, documents, sf_dir, odd, empty):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.classify(documents, labels)
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert found.count() == documents.count()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.8
    some = quality.classify(odd, spark.createDataFrame([(4, 1), (5, 0), (5, None)], "doc_id long, quality int")).collect()
    assert len(some) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in some)
    assert quality.classify(empty, labels).collect() == []


def plain_ranker(x, label, ridge=1e-3):
    """Weights, mean, scale and cut from every pair of rows, one by one."""
    mean = x.mean(axis=0)
    scale = x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    d = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve(ridge * np.eye(len(w)) + (d * (p * (1 - p))[:, None]).T @ d / len(d), p @ d / len(d) - ridge * w)
    return w, mean, scale, np.quantile(z @ w, 1 - label.mean())


def test_quality_learns_from_all_pairs(spark):
    """Weights and cut are those of all pairs of all labelled rows; ids marked twice or repeated count as often."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["good", "words", "BAD!!", "and", "Here", "are 1", "x|y.\n"], rng.integers(3, 60))) for _ in range(120)]
    ids = [*range(115), 3, 3, 4, 5, None]
    marks = [(i, int(texts[i].count("B") / len(texts[i]) + rng.normal() / 100 < 0.03)) for i in range(110)] + [(3, 1), (3, 0), (7, 1), (200, 1), (9, None), (None, 0)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    with common.Scratch(spark) as scratch:
        model = quality.train(scratch, scratch.table("features", quality.featured(docs)), labels)
    rows = [(quality.features(t), q) for i, t in zip(ids, texts, strict=True) for j, q in marks if i == j and q is not None]
    w, mean, scale, cut = plain_ranker(np.array([x for x, _ in rows]), np.array([q for _, q in rows]))
    assert np.abs(model.mean - mean).max() < 1e-6 and np.abs(model.scale - scale).max() < 1e-6
    assert np.abs(model.weights - w).max() < 1e-4 and abs(model.cut - cut) < 1e-3


def test_quality_ranks_are_exact(spark):
    rng = random.Random(8)
    for values in ([(1.0, 5)], [(rng.choice([-3.0, 1e-300, 2e-300, 0.1 + 0.2, 0.3, 7.5, 1e9]), rng.randint(1, 3)) for _ in range(20)], [(rng.gauss(0, 1), 1) for _ in range(300)]):
        table, flat = spark.createDataFrame(values, "value double, n long"), sorted(v for v, n in values for _ in range(n))
        for k in {1, 2, len(flat) // 2, len(flat) - 1}:
            assert quality._ranked(table, k) == (flat[k - 1], flat[k])


def test_decontamination_finds_planted_and_leaves_clean(spark, documents, sf_dir, odd, empty):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: decontaminate.normalised(r.text) for r in benchmark.collect()}
    texts = {r.doc_id: decontaminate.normalised(r.text) for r in documents.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    found = decontaminate.contaminated(documents, benchmark).collect()
    assert want <= {(r.doc_id, r.item_id) for r in found}
    for r in found:
        assert r.edit_distance == edit_distance_within(items[r.item_id], texts[r.doc_id])
        assert r.edit_distance <= decontaminate.MAX_EDITS * len(items[r.item_id])
    assert decontaminate.contaminated(odd, benchmark).collect() == []
    assert decontaminate.contaminated(empty, benchmark).collect() == decontaminate.contaminated(documents, benchmark.filter("false")).collect() == []
    left = decontaminate.clean(documents, benchmark)
    assert left.columns == documents.columns
    assert {r.doc_id for r in left.collect()} == set(texts) - {r.doc_id for r in found}


def edit_distance_within(pattern, text):
    """Edit distance to the closest substring, by the plain dynamic programme."""
    import numpy as np

    p = np.array([ord(c) for c in pattern])
    rows = np.arange(len(p) + 1)
    before, best = rows.copy(), len(p)
    for c in text:
        now = before.copy()
        now[1:] = np.minimum(before[:-1] + (p != ord(c)), before[1:] + 1)
        now[0] = 0
        before = np.minimum.accumulate(now - rows) + rows
        best = min(best, int(before[-1]))
    return best


def edited(text, kind, rate, rng):
    letters = "abcdefghijklmnopqrstuvwxyz "
    chars, n = list(text), int(rate * len(text))
    if kind == "first letters":
        return " ".join(("q" if w[0] != "q" else "x") + w[1:] for w in text.split())
    if kind == "blanks lost":
        return text.replace(" ", "")
    if kind == "every eighth":
        return "".join("q" if k % 8 == 3 and c != "q" else c for k, c in enumerate(chars))
    for at in sorted(rng.sample(range(len(chars)), n), reverse=True):
        if kind == "substitutions":
            chars[at] = rng.choice(letters)
        elif kind == "insertions":
            chars.insert(at, rng.choice(letters))
        else:
            del chars[at]
    return decontaminate.normalised("".join(chars))


EDITS = [(kind, rate) for kind in ("substitutions", "insertions", "deletions") for rate in (0.05, 0.1, 0.15, 0.19)]


@pytest.mark.parametrize("kind,rate", [*EDITS, ("first letters", 0), ("every eighth", 0), ("blanks lost", 0)])
def test_decontamination_recall_against_brute_force(spark, kind, rate):
    """Of the passages within the bound by plain dynamic programming, the share that is found."""
    import random

    rng = random.Random(1)
    items = [decontaminate.normalised(r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").limit(100).collect()]
    passages = ["some words before it " + edited(t, kind, rate, rng) + " and after" for t in items]
    within = [k for k, (i, t) in enumerate(zip(items, passages, strict=True)) if edit_distance_within(i, t) <= decontaminate.MAX_EDITS * len(i)]
    assert len(within) > 80
    found = {f[:2] for f in decontaminate.Items(list(range(len(items))), items).find(passages)}
    # Lost blanks are edits at regular places, near the bound: the hardest case for walks.
    assert sum((k, k) in found for k in within) / len(within) >= (0.9 if kind == "blanks lost" else 0.95)


def regularly(text, k, what):
    """Every k-th letter lost, replaced or swapped with the next."""
    out, at = [], 0
    while at < len(text):
        if at % k != k - 1 or (what == "swapped" and at + 1 == len(text)):
            out.append(text[at])
        elif what == "swapped":
            out += [text[at + 1], text[at]]
            at += 1
        elif what == "replaced":
            out.append("q" if text[at] != "q" else "x")
        at += 1
    return decontaminate.normalised("".join(out))


@pytest.mark.parametrize("size", [None, 79, 70, 63, 52, 45, 40])
def test_decontamination_recall_for_every_length(documents, size):
    """Items cut to a length, in text of the corpus, with random and regular edits near the bound: at least nine of ten are found."""
    import random

    rng = random.Random(1)
    items = [decontaminate.normalised(r) for r in _benchmark_texts()][:100]
    items = [i if size is None else i[:size].strip() for i in items]
    around = [decontaminate.normalised(r.text)[:400] for r in documents.limit(50).collect()]
    held = decontaminate.Items(list(range(len(items))), items)
    cases = [lambda t, kind=kind, rate=rate: edited(t, kind, rate, rng) for kind in ("substitutions", "deletions", "insertions") for rate in (0.1, 0.19)]
    cases += [lambda t, k=k, what=what: regularly(t, k, what) for k, what in ((5, "lost"), (6, "replaced"), (6, "lost"), (12, "swapped"))]
    for number, case in enumerate(cases):
        changed = [case(t) for t in items]
        within = [k for k, (i, c) in enumerate(zip(items, changed, strict=True)) if edit_distance_within(i, c) <= decontaminate.MAX_EDITS * len(i)]
        found = {f[:2] for f in held.find([f"{around[k % 50]} {c} {around[-1 - k % 50]}" for k, c in enumerate(changed)])}
        # Long walks seldom pass between edits at every fifth letter: the documented limit of whole items.
        least = 0.6 if size is None and number == 6 else 0.9
        assert len(within) > 50 and sum((k, k) in found for k in within) >= least * len(within)


def _benchmark_texts():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.1/benchmark.parquet").sort_by("item_id")["text"].to_pylist()


def test_decontamination_of_short_items_is_exact():
    import random

    rng = random.Random(7)
    items = ["".join(rng.choice("abc de") for _ in range(n)) for n in (1, 3, 4, 5, 9, 10, 14, 24, 39, 40)]
    items = [decontaminate.normalised(t) or "z" for t in items] + ["abcdefgh ij"]
    texts = ["".join(rng.choice("abc de") for _ in range(rng.randint(0, 80))) for _ in range(150)] + ["xx abcdefgh xij", None, ""]
    held = decontaminate.Items(list(range(len(items))), items)
    found = {(row, k): e for row, k, e, _ in held.find(texts)}
    short = {k for k, i in enumerate(items) if len(i) < decontaminate.SHORT}
    want = {}
    for row, t in enumerate(texts):
        t = decontaminate.normalised(t)
        for k in short:
            e = edit_distance_within(items[k], t)
            if t and e <= decontaminate.MAX_EDITS * len(items[k]):
                want[row, k] = e
    assert {x: e for x, e in found.items() if x[1] in short} == want and (150, len(items) - 1) in want


def test_decontamination_repeated_rows_and_long_texts(spark):
    item = "when it rains over the valley the river carries away the small stones that lie near the bank"
    long = "lorem ipsum dolor " * 20_000
    rows = [(1, item), (1, item), (2, long + item + long), (3, long)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, searched string")
    benchmark = spark.createDataFrame([(5, item), (6, item), (7, None)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.edit_distance) for r in decontaminate.contaminated(docs, benchmark).collect())
    assert found == [(1, 5, 0), (1, 5, 0), (1, 6, 0), (1, 6, 0), (2, 5, 0), (2, 6, 0)]
    left = decontaminate.clean(docs, benchmark)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [3]


def test_closest_against_plain_dynamic_programming():
    import random

    rng = random.Random(2)
    strings = [tuple("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (150, 300)) for _ in range(60)]
    edits, _ = decontaminate.closest([(decontaminate.Pattern(decontaminate.code_points(p)), decontaminate.code_points(t)) for p, t in strings])
    assert edits.tolist() == [edit_distance_within(p, t) for p, t in strings]


TEXTS = [
    (1, "Mail the.72@mail3.example.com or THE.72@MAIL3.EXAMPLE.COM, call +1 (377) 555-0271, card 4111 1111 1111 1111 and 4111111111111111."),
    (2, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" ip 240.56.125.154, 123-45-6789'),
    (3, "Mr. John Smith met Mrs Mary Jones and Анна Петрова."),
    (4, None),
    (5, ""),
    (6, "nothing 12 34 here"),
    (7, "the.72@mail3.example.com again"),
    (8, "a" * 50_000),
]


def test_pii_surrogates(spark):
    df = spark.createDataFrame([(*r, "x") for r in TEXTS], "doc_id long, text string, kinds string")
    got = {r.doc_id: r for r in pii.replaced(df, KEY).collect()}
    for private in ("the.72@mail3", "THE.72", "555-0271", "4111", "b44e15e0", "240.56", "123-45-6789", "John", "Smith", "Mary", "Петрова"):
        assert not any(private in (r.text or "") for r in got.values())
    first = got[7].text.split()[0]
    assert first in got[1].text and first.upper() in got[1].text
    cards = [w for w in got[1].text.rstrip(".").replace(" and ", "|").split("card ")[1].split("|")]
    assert cards[0].replace(" ", "") == cards[1] and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(cards[1]))) % 10 == 0
    assert got[2].text.startswith('token = "') and got[3].text.startswith("Mr. ") and " Mrs " in got[3].text
    assert got[4].text is None and got[5].text == "" and got[6].text == TEXTS[5][1] and got[8].text == TEXTS[7][1]
    assert got[6].n_entities == 0 and got[6].kinds == [] and got[1].n_entities == 5
    assert pii.replaced(df.filter("false"), KEY).collect() == []


def test_pii_collisions_are_moved(spark, monkeypatch):
    from rainloom.llm.common import Scratch

    monkeypatch.setattr(pii, "surrogate", lambda kind, form, attempt, key="": F.concat(F.lit("s"), ((F.length(form) + attempt) % 7).cast("string")))
    entities = spark.createDataFrame([("email", "a"), ("email", "b"), ("email", "cc"), ("email", "s4")], "kind string, form string")
    with Scratch(spark) as scratch:
        moved = {r.form: r.attempt for r in pii.collisions(entities, scratch, KEY).collect()}
    final = {f: f"s{(len(f) + moved.get(f, 0)) % 7}" for f in ("a", "b", "cc", "s4")}
    assert len(set(final.values())) == 4 and not set(final.values()) & {"a", "b", "cc", "s4"}


def replaced_texts(spark, texts):
    rows = pii.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)], [r.kinds for r in sorted(rows, key=lambda r: r.doc_id)]


def test_pii_after_letters_and_plus(spark):
    texts = ["accessToken=abcd1234efgh", "dbPassword: hunter2hunter2", "clientSecret='Zx81Zx81Zx81'", "to john+news@mail.org or john+news@mail.org.", "VISA4111111111111111 paid"]
    got, kinds = replaced_texts(spark, texts)
    assert kinds == [["secret"], ["secret"], ["secret"], ["email"], ["card"]]
    for private in ("abcd1234", "hunter2", "Zx81", "john", "news", "4111"):
        assert not any(private in g for g in got)
    assert got[0].startswith("accessToken=") and got[1].startswith("dbPassword: ") and got[4].startswith("VISA") and got[4].endswith(" paid")
    assert got[3].split()[1] == got[3].split()[3].rstrip(".")


def test_pii_long_secrets(spark):
    import random

    rng = random.Random(4)
    token, blob = ("".join(rng.choice(letters) for _ in range(n)) for letters, n in (("abcXYZ019", 690), ("0123456789abcdef", 700)))
    key = "ghp_" + "".join(rng.choice("abcXYZ019") for _ in range(400))
    got, kinds = replaced_texts(spark, [f"token={token} end", f"is {blob} end", f"is {key} end", "token=" + "a" * 2_000])
    assert kinds == [["secret"]] * 4
    for g, private in zip(got, (token, blob, key), strict=False):
        assert len(g.split()[-2].removeprefix("token=")) == len(private) and g.endswith(" end")
        assert not any(private[k : k + 20] in g for k in range(len(private) - 20))
    value = got[3].removeprefix("token=")
    assert len(value) == 2_000 and len({value[k : k + 20] for k in range(1_980)}) == 1_980


def test_pii_collision_rounds_go_on(spark):
    from rainloom.llm.common import Scratch

    forms = [("email", f"{c}@mail.org") for c in "abcdefghijklmnopqrstuvwxyz"] + [("secret", "-" * 8), ("phone", "+1" + "0" * 4)]
    forms += [("phone", f"+1{k:04d}") for k in range(1, 6_000)] + [("name", f"m:X{k}") for k in range(70_000)]
    entities = spark.createDataFrame(forms, "kind string, form string")
    with Scratch(spark) as scratch:
        moved = pii.collisions(entities, scratch, KEY)
        final = entities.join(moved, ["kind", "form"], "left").select("kind", "form", pii.surrogate(F.col("kind"), F.col("form"), F.coalesce("attempt", F.lit(0)), KEY).alias("other"))
        final = [tuple(r) for r in final.collect()]
    assert len({(k, o) for k, _, o in final}) == len(forms)
    assert not {(k, o) for k, _, o in final} & set(forms)


def test_pii_longer_surrogates_are_laid_out_whole(spark):
    row = spark.range(1).select(pii.laid_out(F.lit("phone"), F.lit("+1 22 33"), F.lit("+145678")).alias("x")).first()
    assert row.x == "+1 45 678"


def test_pii_people_are_one_person_in_a_document(spark):
    texts = ["John Smith came. Later Mr. John Smith and Smith left; Mr Smith paid, Mrs Smith did not. Smithson stayed.", "Mrs Jones and Dr Smith.", "Paul Street, Charles Bridge and Sarah Lawrence College are places."]
    got, kinds = replaced_texts(spark, texts)
    given, family = got[0].split()[:2]
    assert got[0].startswith(f"{given} {family} came. Later Mr. {given} {family} and {family} left; Mr {family} paid, Mrs ") and got[0].endswith(" did not. Smithson stayed.")
    other = got[0].split("Mrs ")[1].split()[0]
    assert other not in (family, "Smith") and "John" not in got[0] and " Smith " not in got[0]
    assert kinds[:2] == [["name"], ["name"]] and "Jones" not in got[1] and got[2] == texts[2]


def test_pii_numbers_that_are_no_card(spark):
    texts = ["order 4111111111111112 and 9807915762804490 here", "pay 4111111111111111 now", "or 4111 1111 1111 1112"]
    got, kinds = replaced_texts(spark, texts)
    assert kinds == [[], ["card"], ["card"]] and got[0] == texts[0] and "4111" not in got[1] + got[2]


def test_pii_needs_a_key_and_follows_it(spark):
    df = spark.createDataFrame([(1, "to a.person@mail.org"), (1, "to a.person@mail.org")], "doc_id long, text string")
    with pytest.raises(ValueError):
        pii.replaced(df, "")
    one, two = (pii.replaced(df, k).collect() for k in ("k1", "k2"))
    assert one[0] == one[1] and one[0].text != two[0].text


def test_pii_merged_and_broadcast_ways_agree(spark, documents):
    some = documents.unionByName(documents.limit(50))
    ways = [sorted((tuple(r) for r in pii.replaced(some, KEY, n).collect()), key=str) for n in (0, 1_000_000)]
    assert ways[0] == ways[1] and len(ways[0]) == some.count()
