import hashlib
import json
import random

import numpy as np
import pytest

from deskspark.llm import pair_bytes as P

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

PARTS = ["the", "and", "ing", "er", "tion", "Hello", "WORLD", "'s", "'LL", "'", "12", "3", "é", "é", "́", "İ", "Σ"]
PARTS += ["ß", "ẞ", "ﬁ", "漢字", "🤦🏼‍♂️", "각", "Å", "½", "٣", "ͅ", "ǅ", "\x00", "\x1c", "\x1f", "\x7f", "\x85"]
PARTS += [" ", "\n", "\t", "\xa0", " ", "　", "<|endoftext|>", "<|startoftext|>", "<|endof", "|>", "</w>", "...", "=", "_", "q"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def told():
    return P.load_tokenizer(PATH)


def made(seed, n):
    draw = random.Random(seed)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 12))) for _ in range(n)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(1, 70))) for _ in range(n // 4)]
    return texts + ["a" * k for k in range(1, 60)] + ["ab" * k for k in range(1, 40)] + ["=" * k for k in range(1, 70)]


def test_ids_equal_the_library(told, library, monkeypatch):
    texts = made(1, 4000)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = P.Encoder(told)

    def coded(some):
        ids, at = encoder.encode([t.encode() for t in some])
        return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]

    assert coded(texts) == want
    # Met before, in small blocks, and after forgetting.
    monkeypatch.setattr(P, "BLOCK_SYMBOLS", 16)
    monkeypatch.setattr(P, "KNOWN_STRETCHES", 100)
    for at in range(0, len(texts), 97):
        assert coded(texts[at : at + 97]) == want[at : at + 97]
    assert coded([]) == []


def test_both_ways_of_merging_agree(told, library, monkeypatch):
    words = [t for t in made(2, 400) if t.isascii() and t.isalpha() and t.islower()]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    encoder = P.Encoder(told)
    for word, ids in zip(words, want):
        symbols = encoder.symbol[[ord(c) for c in word]]
        symbols[-1] += 256
        assert encoder.merge(symbols) == ids
        assert [i.tolist() for _, i in encoder.merge_alike(symbols[None])] == [[ids]]
    monkeypatch.setattr(P, "SHORT_WORD", 5)
    ids, at = encoder.encode([w.encode() for w in words])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def plain_merge(ids, rank_of):
    """Lowest rank first, leftmost among equals."""
    ids = list(ids)
    while True:
        ranks = [rank_of.get(p, (P.NEVER, 0)) for p in zip(ids, ids[1:])]
        if not ranks or min(ranks)[0] == P.NEVER:
            return ids
        i = ranks.index(min(ranks))
        ids[i : i + 2] = [ranks[i][1]]


@pytest.mark.parametrize("seed", range(12))
def test_pairs_that_fit_are_those_that_merge_to_themselves(seed):
    """Random vocabularies of two or three letters, where ties and runs abound."""
    draw = random.Random(seed)
    letters = 2 + seed % 2
    merges, text_of = [], {i: chr(97 + i) for i in range(letters)}
    while len(merges) < 14:
        a, b = draw.choice(list(text_of)), draw.choice(list(text_of))
        if text_of[a] + text_of[b] not in text_of.values():
            new = letters + len(merges)
            merges.append((a, b, new))
            text_of[new] = text_of[a] + text_of[b]
    rank_of = {(a, b): (r, new) for r, (a, b, new) in enumerate(merges)}
    tables = P._tables(np.arange(letters), np.array(merges, np.int64), len(text_of))
    alone = {t: plain_merge([ord(c) - 97 for c in s], rank_of) == [t] for t, s in text_of.items()}
    assert {int(t) for t in tables["accepts"] if t >= 0} == {t for t, ok in alone.items() if ok}
    good = [t for t, ok in alone.items() if ok]
    pairs = [(a, b) for a in good for b in good]
    fit = P.fits(tables, *np.array(pairs).T)
    for (a, b), ok in zip(pairs, fit):
        assert ok == (plain_merge([ord(c) - 97 for c in text_of[a] + text_of[b]], rank_of) == [a, b])


def test_query_columns(spark, frame, odd, library, told):
    docs = [*odd, *enumerate(made(3, 120)), (5, "one more text with an id that is there"), (6, None)]
    coded = P.encode_texts(frame(docs), PATH, keep_rows=True)
    assert {r.row.doc_id for r in coded.collect()} == {i for i, _ in docs}
    rows = P.token_digest(P.decode_ids(coded, PATH)).collect()

    def want(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), decoded)]
        return len(ids), *sha

    assert sorted((repr(r[0]), *r[1:]) for r in rows) == sorted((repr(i), *want(t)) for i, t in docs)
    assert P.token_digest(P.decode_ids(P.encode_texts(frame([]), PATH), PATH)).count() == 0


def test_decoding_leaves_out_what_is_no_token(spark):
    rows = spark.createDataFrame(
        [(1, [3306, None, 99999, -1, 49407], "x"), (2, None, "y"), (3, [], "z")], "doc_id long, ids array<int>, decoded string"
    )
    got = {r.doc_id: r.decoded for r in P.decode_ids(rows, PATH).collect()}
    assert got == {1: "hello</w> <|endoftext|>", 2: "", 3: ""}


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        P.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "wrong.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        P.load_tokenizer(str(tmp_path / "wrong.json"))
