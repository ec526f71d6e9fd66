"""Byte-pair encoding by guess and proof, and decoding.

A word's tokens are guessed as the longest vocabulary entry at each place. The
guess is right exactly if every two neighbours could stand side by side: no
merge across their border comes before the merges that hide the border's
symbols. That is a question about pairs, answered for all pairs at once. Only
words with a pair that fails are merged step by step.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from deskspark.llm.arrow_text import batch_of, id_and_text, map_batches, pieces, schema_with_rows, text_bytes, with_rows

#: Text taken apart at once, and symbols guessed at once; a longer text or word is taken alone.
PIECE_BYTES = 2 << 20
BLOCK_SYMBOLS = 1 << 20
#: Stretches between white space a task remembers, and their bytes, before it begins anew.
KNOWN_STRETCHES = 300_000
KNOWN_BYTES = 32 << 20
LETTERS = r"[\p{L}]+"
NEVER = (1 << 63) - 1
#: Symbols up to which words are merged side by side; longer ones have a heap each.
SHORT_WORD = 48
#: Words left below which tokens are followed word by word, as a few long words would take many steps.
FEW_WORDS = 32


def load_tokenizer(path: str) -> dict:
    """What a tokenizer file says, as plain lists and arrays that travel with a job.

    Taken are byte-level word tokenizers with an end-of-word mark: lower-cased
    NFC text, words found by a pattern, merges in the order they were learned.
    Another kind is a ``ValueError``.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    steps = [step["type"] for step in (spec["normalizer"] or {}).get("normalizers", [])]
    before = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in before] != ["Split", "ByteLevel"]:
        raise ValueError("not a lower-casing byte-level word tokenizer")
    if before[0]["behavior"] != "Removed" or not before[0]["invert"] or before[1]["use_regex"] or before[1]["add_prefix_space"]:
        raise ValueError("words must be what the pattern matches")
    if regex.compile(before[0]["pattern"]["Regex"]).groups:
        raise ValueError("the pattern must not capture")
    ending = model["end_of_word_suffix"]
    if model["type"] != "BPE" or not ending or any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError("not plain byte-pair merges with an end-of-word mark")
    if spec["post_processor"] or spec["decoder"]:
        raise ValueError("no post-processor or decoder is known here")
    vocab = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = {a + b for a, b in merges}
    inside = sorted(t for t in vocab if t not in made and len(t) == 1)
    if len(inside) != 256 or len(made) != len(merges) or len(vocab) != 512 + len(merges):
        raise ValueError("merges and vocabulary do not belong together")
    special = [(t["id"], t["content"]) for t in spec["added_tokens"]]
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"]):
        raise ValueError("special tokens must be plain strings without white space")
    names = [""] * (1 + max([*vocab.values(), *[i for i, _ in special]]))
    for token, i in [*vocab.items(), *[(t, i) for i, t in special]]:
        names[i] = token
    tables = _tables(
        np.array([vocab[c] for c in inside] + [vocab[c + ending] for c in inside]),
        np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3),
        len(names),
    )
    shape = {"normalizer": spec["normalizer"], "pre_tokenizer": spec["pre_tokenizer"]}
    return {
        "shape": json.dumps(shape),
        "pattern": before[0]["pattern"]["Regex"],
        "bytes": "".join(inside),
        "special": special,
        "names": names,
        **tables,
    }


def _tables(base: np.ndarray, merges: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Merge ranks, the halves of every token, and a trie of the tokens that encode as themselves."""
    left, right = np.full(size, -1), np.full(size, -1)
    rank = np.full(size, -1)
    left[merges[:, 2]], right[merges[:, 2]] = merges[:, 0], merges[:, 1]
    rank[merges[:, 2]] = np.arange(len(merges))
    if len(merges) and (rank[merges[:, :2]].max(1) >= np.arange(len(merges))).any():
        raise ValueError("a merge needs a token that a later one makes")
    keys = merges[:, 0] * size + merges[:, 1]
    order = np.argsort(keys)
    tables = {"left": left, "right": right, "rank": rank, "pairs": keys[order], "pair_rank": order}
    found = fits(tables, merges[:, 0], merges[:, 1], np.arange(len(merges)))
    symbols = {int(t): (s,) for s, t in enumerate(base)}
    alone = set(base.tolist())
    for (a, b, made), ok in zip(merges.tolist(), found.tolist()):
        symbols[made] = symbols[a] + symbols[b]
        # A half that does not come about alone does not come about here either.
        if ok and a in alone and b in alone:
            alone.add(made)
    nodes: dict[int, int] = {}
    accepts = [-1]
    for token in sorted(alone):
        at = 0
        for s in symbols[token]:
            key = at * len(base) + s
            at = nodes.get(key, 0)
            if not at:
                at = nodes[key] = len(accepts)
                accepts.append(-1)
        accepts[at] = token
    edges = np.array(sorted(nodes), np.int64)
    return {
        **tables,
        "base": base,
        "edges": edges,
        "below": np.array([nodes[k] for k in edges.tolist()], np.int64),
        "accepts": np.array(accepts, np.int64),
        "merged": merges[:, 2].copy(),
    }


def _rank_of(tables: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of the merge of each pair, ``NEVER`` if there is none."""
    keys = left * len(tables["rank"]) + right
    if not len(tables["pairs"]):
        return np.full(keys.shape, NEVER)
    at = np.minimum(np.searchsorted(tables["pairs"], keys), len(tables["pairs"]) - 1)
    return np.where(tables["pairs"][at] == keys, tables["pair_rank"][at], NEVER)


def fits(tables: dict, left: np.ndarray, right: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
    """Whether the tokens of each pair stay apart when their text is merged.

    Merges go by rank, from the left among equals. Looking back from the whole
    tokens, the symbols at the border are known for every moment: the token made
    last is the one to take apart. A border is crossed if its two symbols merge
    before either becomes part of a larger token; an equal rank comes first on
    the left. ``until`` looks no further than a rank.
    """
    left, right = left.astype(np.int64), right.astype(np.int64)
    left_gone = np.full(len(left), NEVER) if until is None else until.astype(np.int64)
    right_gone = left_gone.copy()
    left_gone = left_gone.copy()
    ok = np.ones(len(left), bool)
    open_ = np.arange(len(left))
    rank = tables["rank"]
    while len(open_):
        a, b = left[open_], right[open_]
        across = _rank_of(tables, a, b)
        crossed = (across < left_gone[open_]) & (across <= right_gone[open_])
        ok[open_[crossed]] = False
        rank_a, rank_b = rank[a], rank[b]
        on = ~crossed & (np.maximum(rank_a, rank_b) >= 0)
        back_left = on & (rank_a > rank_b)
        back_right = on & ~back_left
        at = open_[back_left]
        left_gone[at], left[at] = rank_a[back_left], tables["right"][a[back_left]]
        at = open_[back_right]
        right_gone[at], right[at] = rank_b[back_right], tables["left"][b[back_right]]
        open_ = open_[on]
    return ok


class Ragged:
    """Rows of numbers of any length, added at the end and gathered by row number."""

    def __init__(self) -> None:
        self.flat, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def rows(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``index`` one after the other, and where each ends."""
        sizes = self.size[index]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.at[index] - (ends - sizes), sizes) + np.arange(total)], ends


class Encoder:
    """Encodes texts, batch by batch, remembering words and stretches between white space it has met."""

    def __init__(self, told: dict) -> None:
        from tokenizers import Tokenizer

        self.tables = told
        empty = {"version": "1.0", "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}
        shaper = Tokenizer.from_str(json.dumps({**empty, **json.loads(told["shape"])}))
        self.normalize = shaper.normalizer.normalize_str
        self.split = shaper.pre_tokenizer.pre_tokenize_str
        self.plain_words = regex.compile(told["pattern"]).findall
        # Letters are one word if no way to match one comes before the run of letters.
        ways = told["pattern"].split("|")
        run = ways.index(LETTERS) if LETTERS in ways else 0
        apart = not any(content.isalpha() for _, content in told["special"])
        self.letters_stay = LETTERS in ways and apart and all(w.startswith("'") for w in ways[:run])
        self.symbol = np.zeros(max(map(ord, told["bytes"])) + 1, np.int64)
        self.symbol[[ord(c) for c in told["bytes"]]] = np.arange(256)
        self.special = {content: (i,) for i, content in told["special"]}
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.merge_of: dict[int, int] | None = None
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0
        self.words_in = Ragged()
        self.word_number: dict[str | tuple[int], int] = {}
        self.ids_of = Ragged()

    def encode(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (one more at the end)."""
        if len(self.known) > KNOWN_STRETCHES or self.known_bytes > KNOWN_BYTES:
            self.forget()
        # Words never reach over white space, and composition does not either.
        stretches = [t.split() for t in texts]
        fresh = set(chain.from_iterable(stretches)).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        counts = np.array([len(some) for some in stretches], np.int64)
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(stretches)), np.int64, int(counts.sum()))
        words, word_ends = self.words_in.rows(index)
        ids, id_ends = self.ids_of.rows(words)
        # From texts to stretches to words to ids.
        upto = np.concatenate([[0], word_ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.concatenate([[0], id_ends])[upto]

    def learn(self, stretches: list[bytes]) -> None:
        """Take stretches not met before into words, encode new words, and remember both."""
        parts = [
            [s.lower().decode()] if self.letters_stay and s.isalpha() else self.words_of(s.decode()) for s in stretches
        ]
        number = self.word_number
        fresh = list(dict.fromkeys(w for part in parts for w in part if w not in number))
        number.update(zip(fresh, range(len(number), len(number) + len(fresh))))
        sizes = np.array([0 if isinstance(w, tuple) else len(w) for w in fresh], np.int64)
        for first, last in pieces(np.cumsum(np.concatenate([[0], sizes])), BLOCK_SYMBOLS):
            self.ids_of.add(*self._encode_block(fresh[first:last]))
        counts = np.array([len(part) for part in parts], np.int64)
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        first = len(self.words_in.size)
        self.words_in.add(flat, counts)
        self.known.update(zip(stretches, range(first, first + len(stretches))))
        self.known_bytes += sum(map(len, stretches))

    def words_of(self, stretch: str) -> list[str | tuple[int]]:
        """The words of a stretch in byte letters; special tokens as a tuple of their id."""
        if self.cut is None or not self.cut.search(stretch):
            return self._plain(stretch)
        parts = enumerate(self.cut.split(stretch))
        return [w for k, part in parts for w in ([self.special[part]] if k % 2 else self._plain(part))]

    def _plain(self, part: str) -> list[str]:
        # Visible ASCII is its own composed form and its own byte letters.
        if part.isascii() and part.isprintable():
            return self.plain_words(part.lower())
        return [word for word, _ in self.split(self.normalize(part))]

    def _encode_block(self, words: list[str | tuple[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and how many each has: guessed, proved by pairs, merged where that fails."""
        special = {w: word[0] for w, word in enumerate(words) if isinstance(word, tuple)}
        texts = ["" if isinstance(w, tuple) else w for w in words] if special else words
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        symbols = self.symbol[points]
        ends = np.cumsum([len(w) for w in texts], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        symbols[ends[ends > starts] - 1] += 256
        token, length = self._longest(symbols, starts, ends)
        begins = self._from_start_to_end(length, starts, ends)
        flat, owner = token[begins], np.searchsorted(ends, np.flatnonzero(begins), "right")
        size = len(self.tables["rank"])
        beside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[beside] * size + flat[beside + 1], return_inverse=True)
        proved = fits(self.tables, *np.divmod(pairs, size))
        counts = np.bincount(owner, minlength=len(words))
        out, rows = Ragged(), np.arange(len(words))
        out.add(flat, counts)

        def instead(which: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
            rows[which] = len(out.size) + np.arange(len(which))
            out.add(flat, counts)

        failed = np.unique(owner[beside[~proved[which]]])
        sizes = (ends - starts)[failed]
        for n in np.unique(sizes[sizes <= SHORT_WORD]).tolist():
            some = failed[sizes == n]
            for left, ids in self.merge_alike(symbols[starts[some][:, None] + np.arange(n)]):
                instead(some[left], ids.ravel(), np.full(len(ids), ids.shape[1]))
        for w in failed[sizes > SHORT_WORD].tolist():
            ids = self.merge(symbols[starts[w] : ends[w]])
            instead(np.array([w]), np.array(ids), np.array([len(ids)]))
        instead(np.array(list(special), np.int64), np.array(list(special.values()), np.int64), np.ones(len(special), np.int64))
        return out.rows(rows)[0], out.size[rows]

    @staticmethod
    def _from_start_to_end(length: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which places begin a token, going from each word's start from token to token, all words side by side."""
        begins = np.zeros(len(length), bool)
        at, end = starts[ends > starts], ends[ends > starts]
        while len(at) > FEW_WORDS:
            begins[at] = True
            at = at + length[at]
            at, end = at[at < end], end[at < end]
        if len(at):
            step = length.tolist()
            for place, stop in zip(at.tolist(), end.tolist()):
                while place < stop:
                    begins[place] = True
                    place += step[place]
        return begins

    def _longest(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token at every place, and its length in symbols."""
        n, t = len(symbols), self.tables
        token, length = np.zeros(n, np.int64), np.ones(n, np.int64)
        limit = np.repeat(ends, ends - starts)
        place, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(place):
            keys = node * len(t["base"]) + symbols[place + depth]
            at = np.minimum(np.searchsorted(t["edges"], keys), len(t["edges"]) - 1)
            goes = t["edges"][at] == keys
            place, node = place[goes], t["below"][at[goes]]
            depth += 1
            hit = t["accepts"][node]
            token[place[hit >= 0]], length[place[hit >= 0]] = hit[hit >= 0], depth
            more = place + depth < limit[place]
            place, node = place[more], node[more]
        return token, length

    def merge_alike(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length, merged step by step side by side: which of them are done, and their ids.

        Each step makes the lowest merge of every word that has one, the
        leftmost among equals, so all words left are one symbol shorter then.
        """
        ids, row = self.tables["base"][symbols], np.arange(len(symbols))
        ranks = _rank_of(self.tables, ids[:, :-1], ids[:, 1:])
        while len(row) and ids.shape[1] > 1:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(row)), at]
            goes = least < NEVER
            if not goes.all():
                yield row[~goes], ids[~goes]
                row, ids, ranks, at, least = row[goes], ids[goes], ranks[goes], at[goes], least[goes]
            n, every = ids.shape[1], np.arange(len(row))
            ids[every, at] = self.tables["merged"][least]
            ids = ids[np.arange(n) != at[:, None] + 1].reshape(len(row), n - 1)
            ranks = ranks[np.arange(n - 1) != at[:, None]].reshape(len(row), n - 2)
            for side, pair in ((at > 0, at - 1), (at < n - 2, at)):
                r, c = every[side], pair[side]
                ranks[r, c] = _rank_of(self.tables, ids[r, c], ids[r, c + 1])
        if len(row):
            yield row, ids

    def merge(self, symbols: np.ndarray) -> list[int]:
        """One long word merged step by step: the lowest rank first, from the left among equals."""
        size = len(self.tables["rank"])
        if self.merge_of is None:
            self.merge_of = dict(zip(self.tables["pairs"].tolist(), self.tables["pair_rank"].tolist()))
            self.made_of = self.tables["merged"].tolist()
        ids = self.tables["base"][symbols].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                rank = self.merge_of.get(ids[i] * size + ids[after[i]])
                if rank is not None:
                    heapq.heappush(waiting, (rank, i, ids[i], ids[after[i]]))

        for i in range(n):
            offer(i)
        while waiting:
            rank, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made_of[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [t for t in ids if t >= 0]


def encode_texts(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", keep_rows: bool = False
) -> DataFrame:
    """``doc_id, ids`` of every row: the text's token ids as an array.

    ``tokenizer`` is the path of a tokenizer file that the driver can read; its
    tables are broadcast, a few MB whatever the input. With ``keep_rows`` a
    column ``row`` carries the document's own columns. A map without shuffle.
    Null and empty texts and texts of white space have no ids; strings of special
    tokens in a text become those tokens. Repeated rows each count, null ids stay
    null, other columns are ignored, an empty table gives an empty one. Memory is
    bounded by one piece of text or one text, and by what a task remembers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_tokenizer(tokenizer))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            parts = []
            for first, last in pieces(starts, PIECE_BYTES):
                bounds = starts[first : last + 1].tolist()
                ids, at = encoder.encode([data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])])
                parts.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
            column = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
            told = batch_of(["doc_id", "ids"], [batch.column(0), column], [batch.column(0).type, pa.list_(pa.int32())])
            yield with_rows(batch, told)

    rows = id_and_text(docs, doc_id, text, keep_rows)
    return map_batches(rows, task, schema_with_rows(rows, "ids array<int>"))


def decode_ids(coded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``coded`` with a column ``decoded``: the strings of all tokens, special ones too, with spaces between them.

    Null and unknown ids are left out; a null or empty array gives the empty
    text. A column ``decoded`` that is there already is replaced.
    """
    shared = coded.sparkSession.sparkContext.broadcast(load_tokenizer(tokenizer)["names"])
    keep = [F.col(f"`{c}`") for c in coded.columns]
    rows = coded.select(F.col(ids).cast("array<int>").alias("ids"), F.struct(*keep).alias("row"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value, pa.string())
        real = np.array([bool(n) for n in shared.value])
        for batch in batches:
            told = batch.column(0)
            lengths = pc.fill_null(pc.list_value_length(told), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(told.flatten(), -1).to_numpy(zero_copy_only=False)
            good = (flat >= 0) & (flat < len(real))
            good[good] = real[flat[good]]
            ends = np.cumsum(lengths)
            left = np.concatenate([[0], np.cumsum(good)])[np.concatenate([[0], ends])]
            lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), names.take(pa.array(flat[good])))
            text = pc.binary_join(lists, " ")
            yield batch_of(["row", "decoded"], [batch.column(1), text], [batch.column(1).type, pa.string()])

    names = [c for c in coded.columns if c != "decoded"]
    told = map_batches(rows, task, _with_decoded(rows))
    return told.select(*[F.col("row")[c].alias(c) for c in names], "decoded")


def _with_decoded(rows: DataFrame) -> StructType:
    return StructType([StructField("row", rows.schema["row"].dataType), StructField("decoded", StringType())])


def token_digest(decoded: DataFrame) -> DataFrame:
    """The digest columns of the query, derived from ids and decoded text."""
    told = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(told.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
