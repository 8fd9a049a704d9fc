"""Filter audit, packing and tokenizer alignment against plain versions."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rainloom.llm import align, audit, packing, runs, words
from rainloom.llm.queries import SIDE_A, SIDE_B, WORDS, op12_packing, op13_tokenizer_alignment

PATHS = public_tokenizers.path(SIDE_A), public_tokenizers.path(SIDE_B)
ODD_TEXTS = [
    "", " ", "   two  gaps   ", "a\n  b\n\n c\t\td", "x  y　  z", "tab\tafter   line", "<|endoftext|> <|startoftext|>", "▁ under▁bar", "日本語 🙂 ÀÉ ñ é ́x",
    "nul\u0000byte", "$x = 3; A&B | 50% *#", "don't  we'll I'M", "  \n\n  \n", "\x1c \x1d  x \x85 y", "x" * 3_000, "word " * 2_000, "é" * 500 + " " * 300 + "b", "﻿ bom  ​ zero", "1234567 89 ٣٤",
]


def texts_of(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeXY  \n\té日#$.,'12") for _ in range(rng.randint(0, 400))) for _ in range(n)]


def plain_counts(text: str) -> list[int]:
    blank = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
    words = [w for w in text.translate({ord(c): " " for c in blank}).split(" ") if w]
    return [len(words), len(set(words)), len(text), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text)]


def plain_audit(rows, labels):
    """The audit row by row: every order, every step, every document."""
    smallest, good, toxic = {}, set(), set()
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()
    docs = defaultdict(list)
    for i, text, lang in rows:
        text = text or ""
        words, distinct, chars, capitals, symbols = plain_counts(text)
        fails = [words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * chars, symbols > 0, i is not None and smallest[text] < i]
        docs[lang or ""].append(({c for c, f in zip("ABCDE", fails, strict=True) if f}, i in good, i in toxic))
    out = []
    for part, all_docs in docs.items():
        shapley = Counter()
        told = []
        for order in itertools.permutations("ABCDE"):
            left = all_docs
            for step, letter in enumerate(order):
                removed = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                shapley[letter] += len(removed)
                failing = sum(letter in d[0] for d in all_docs)
                told.append([part, "".join(order), step + 1, len(left), len(removed), failing - len(removed), sum(d[0] == {letter} for d in all_docs), sum(d[1] for d in removed), sum(d[2] for d in removed), letter])
        out += [(*t[:-1], shapley[t[-1]]) for t in told]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("block", [audit.BLOCK, 64])
def test_counts_are_exact(monkeypatch, block):
    monkeypatch.setattr(audit, "BLOCK", block)
    texts = ODD_TEXTS + texts_of(1, 60) + ["repeat again " * 300 + "once", "a" * 200 + " " + "a" * 200 + " " + "a" * 201, "same\u0000 same same\u0000\u0000"]
    got = audit.counts_of(pa.array(["left out", *texts])[1:])
    assert got.tolist() == [plain_counts(t) for t in texts]


def test_words_with_one_hash_are_told_apart(monkeypatch):
    """With a hash of three values nearly all words collide; the distinct counts stay exact."""
    monkeypatch.setattr(audit, "_hashes", lambda raw, starts, sizes: (sizes % 3).astype(np.uint64))
    for block in (audit.BLOCK, 64):
        monkeypatch.setattr(audit, "BLOCK", block)
        texts = ODD_TEXTS[:9] + texts_of(2, 30)
        assert audit.counts_of(pa.array(texts)).tolist() == [plain_counts(t) for t in texts]


def test_audit_is_the_plain_one(spark, odd, documents):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "A B c " * rng.choice([1, 30, 60]), f"w{rng.random()} " * 120]), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    labels = [(rng.choice([None, *range(50)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, lang string"), odd, documents):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
        got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert got.columns == COLUMNS and sorted(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_audit_of_nothing(spark, empty):
    assert audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_pieces_have_the_ids_of_whole_texts():
    """Pieces of any size: the ids that the libraries give for whole texts."""
    words = Tokenizer.from_file(public_tokenizers.path(WORDS))
    with open(PATHS[0], encoding="utf-8") as file:
        a = align._byte_level(file.read())
    with open(PATHS[1], "rb") as file:
        b = align._pieces(file.read())
    with open(PATHS[0], encoding="utf-8") as file:
        ranked = align._byte_level(file.read(), public_tokenizers.PATTERN)
    texts = [f" {t}" for t in ODD_TEXTS + texts_of(7, 80) + ["one two  three\n four's !! 5 6 " * 40] if t]
    for encode in (lambda ts: [e.ids for e in words.encode_batch(ts, add_special_tokens=False)], a.encode, ranked.encode, b.encode):
        want = (a.encode if encode == ranked.encode else encode)(texts)
        for size in (1, 7, 100, 10**6):
            assert all("".join(runs.pieces(t, size)) == t for t in texts)
            assert [i.tolist() for i in runs.ids_of(texts, encode, size, 500)] == want


# Packing


@pytest.fixture(scope="module")
def word_ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORDS))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def check_packed(rows, docs, word_ids, size):
    """Each id in one piece, sequences without gaps or overlaps; returns the padding and all ids."""
    want = Counter((i, tuple(word_ids(t))) for i, t in docs)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<i4")
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, tuple(ids.tolist()), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i in {i for i, _ in docs}:
        mine = [list(k[1]) for k in want.elements() if k[0] == i]
        if len(mine) == 1:
            assert [x for p in sorted(pieces[i]) for x in p[1]] == mine[0] and {p[2] for p in pieces[i]} == {len(mine[0])}
        else:  # rows repeated with one id: the same ids in all
            assert Counter(x for p in pieces[i] for x in p[1]) == Counter(x for m in mine for x in m)
    padding = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, sum(len(k[1]) for k in want.elements())


@pytest.mark.parametrize(("size", "group"), [(packing.SIZE, packing.GROUP), (64, 20)])
def test_packing(spark, documents, odd, empty, word_ids, size, group):
    for docs in (documents, odd, spark.createDataFrame(list(enumerate(ODD_TEXTS + texts_of(4, 50))), "doc_id long, text string")):
        rows = packing.pack(docs, public_tokenizers.path(WORDS), size, group=group).collect()
        padding, total = check_packed(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], word_ids, size)
        assert padding <= 0.01 * total + packing.MIN_GAP
    assert packing.pack(empty, public_tokenizers.path(WORDS)).collect() == []


def test_words_have_the_ids_of_whole_texts(monkeypatch):
    """Each different word is encoded once, and ids are those of whole texts, for marks, cases, control characters and added tokens too."""
    with open(public_tokenizers.path(WORDS), encoding="utf-8") as file:
        content = file.read()
    rng = random.Random(11)
    letters = "abAB'sStreélLÉİıſḴ\u0338\u0301ß×÷ªº²½日Σς<|>\u3000" + "".join(map(chr, range(0x250)))
    texts = [*ODD_TEXTS, *texts_of(12, 100), *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2_000))]
    texts += [rng.choice(["don't WE'LL", "x's't'd 'S", "<|endoftext|>", "a<|startoftext|>b", "H\u0331e"]) + "".join(rng.choice("ab'sdt<|> H\u0331\n") for _ in range(30)) for _ in range(500)]
    whole = words.Words(content)
    want = whole.whole(texts)
    for known in (words.KNOWN, 3):
        monkeypatch.setattr(words, "KNOWN", known)
        got = words.Words(content)
        assert got.parts is not None and [i.tolist() for i in got.encode(pa.array(["left out", None, *texts])[1:])] == [[], *want]
    # A file with other steps is used for whole texts.
    other = words.Words(content.replace('"type":"NFC"', '"type":"NFKC"').replace('"type": "NFC"', '"type": "NFKC"'))
    assert other.parts is None and [i.tolist() for i in other.encode(pa.array(texts[:100]))] == other.whole(texts[:100])


def test_a_word_met_again_is_not_encoded_again():
    with open(public_tokenizers.path(WORDS), encoding="utf-8") as file:
        met = words.Words(file.read())
    seen = []
    part, whole = met._part, met.whole
    met._part = lambda p: seen.append(p) or part(p)
    met.whole = lambda ts: seen.extend(ts) or whole(ts)
    for _ in range(2):
        met.encode(pa.array(["Some words, some Words " * 1_000, "words\tsome, é" * 10]))
    assert len(seen) == len(set(seen)) <= 6


def test_first_fit_decreasing_is_the_plain_one():
    rng = random.Random(5)
    for _ in range(30):
        size = rng.choice([10, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 80))]
        room, want = [], {}
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            s = next((s for s, r in enumerate(room) if r >= lengths[k]), len(room))
            if s == len(room):
                room.append(size)
            want[k] = (s, size - room[s])
            room[s] -= lengths[k]
        where, offset, fill = packing.first_fit(np.array(lengths), size)
        assert {k: (int(where[k]), int(offset[k])) for k in want} == want and fill == [size - r for r in room]
        pieces = packing.plan(np.array(lengths), size, 1)
        assert sum(p[2] for p in pieces) == sum(lengths) and {p[0] for p in pieces} == set(range(len(lengths)))
    assert packing.plan(np.zeros(0, np.int64), 8) == []


def test_packing_query(spark, sf_dir, documents, word_ids):
    rows = op12_packing(spark, sf_dir).collect()
    want = {r.doc_id: word_ids(r.text) for r in documents.collect()}
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])


# Alignment


def plain_alignment(rows):
    """Tokens, spans, cuts and overlaps of every pair, document by document."""
    a_side = Tokenizer.from_file(PATHS[0])
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    found, held = [], Counter()
    for doc_id, text in rows:
        a = [(i, bytes(byte[c] for c in a_side.id_to_token(i))) for i in a_side.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()) for i in b_side.encode(text) for p in [b_side.id_to_piece(i)]] if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        group_of = {hi: k for k, hi in enumerate(cuts)}
        groups = [([], []) for _ in cuts]
        for side, out in ((spans[0], 0), (spans[1], 1)):
            k = 0
            for i, _, e in side:
                groups[k][out].append(str(i))
                k += e in group_of
        links = []
        k = 0
        for i, s, e in spans[0]:
            while k < len(spans[1]) and spans[1][k][2] <= s:
                k += 1
            for j, u, v in spans[1][k:]:
                if u >= e:
                    break
                links.append((i, j))
        held.update(set(links))
        text_of = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)
        found.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(text_of.encode()).hexdigest() if a else ""))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(n, best.get(i, 0))
    return [(d, n_a, n_b, g, len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), t) for d, n_a, n_b, g, links, t in found]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def digested(df):
    return [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in map(tuple, df.collect())]


@pytest.mark.parametrize(("broadcast", "pattern"), [(align.BROADCAST_PAIRS, None), (0, public_tokenizers.PATTERN)])
def test_alignment(spark, odd, broadcast, pattern):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS + texts_of(6, 60))) + [(0, ODD_TEXTS[0]), (9, ODD_TEXTS[9]), (None, "no id"), (7, None)], "doc_id long, text string")
    for df in (docs, odd):
        want = plain_alignment([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        assert order(digested(align.align(df, *PATHS, pattern, part_bytes=20_000, broadcast_pairs=broadcast))) == order(want)


def test_alignment_shuffles_no_tokens(spark, documents):
    """Tokens stay where their document is: the plan of what is written has no exchange and no window."""
    rows = documents.select("doc_id", "text")
    side = [align.Tokens(spark, p) for p in PATHS]
    plan = rows.mapInArrow(align._align(*side, align.PART_BYTES), align._ALIGNED)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "MapInArrow" in plan


def test_alignment_of_nothing(empty):
    assert align.align(empty, *PATHS).collect() == []


def test_alignment_query(spark, sf_dir, documents):
    want = plain_alignment([(r.doc_id, r.text) for r in documents.collect()])
    assert order([tuple(r) for r in op13_tokenizer_alignment(spark, sf_dir).collect()]) == order(want)
