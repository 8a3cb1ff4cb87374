"""Byte-level BPE encoding and decoding by speculation and verification.

A text is cut into words by the tokenizer's pattern. For words not met before, greedy longest match in the vocabulary
proposes tokens, and all neighbouring pairs of all proposals are tested at once: a pair is compatible when no merge rule
would ever join the right edge of the first token with the left edge of the second. A proposal whose pairs are all
compatible is the merge result; only the other words are merged step by step. Encoded words are kept in a bounded cache, under 64-bit hashes.

Defined results: null is the empty text and has no tokens; the marker of the tokenizer's special token inside a text
becomes that token, as in the library; repeated rows give repeated results; other columns are carried along unless they
have a name of the output, which then wins.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palaver.llm import columns as C
from palaver.llm.textbatch import PIECE_BYTES, pieces, span_hashes, words

# Fixed values of the format: the word pattern and the printable stand-ins of bytes.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

CACHE_WORDS = 300_000
LONG_WORD = 200
#: ASCII blanks other than the space and the line end, and the first bytes of all longer ones.
OTHER_BLANK = np.zeros(256, dtype=bool)
OTHER_BLANK[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
WIDE_LEAD = np.zeros(256, dtype=bool)
WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: ASCII letters, digits and marks, which the pattern cuts where the kind changes; the apostrophe and all other bytes are 3.
KIND = np.full(256, 3, dtype=np.uint8)
KIND[33:127] = 2
KIND[[*range(65, 91), *range(97, 123)]] = 0
KIND[48:58] = 1
KIND[0x27] = 3


def byte_stand_ins() -> dict[str, int]:
    """Character that stands for each byte in a vocabulary file: bytes without a plain form follow from 256 on."""
    others = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = byte_stand_ins()
        vocab: dict[bytes, int] = {bytes(stand_in[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.text_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.text_of[i] = token
        for token, i in self.special.items():
            self.text_of[i] = token.encode()
        self._marks = {t.encode(): np.array([i], dtype="<u4").tobytes() for t, i in self.special.items()}
        self.words = regex.compile(WORD_PATTERN)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._byte_ids = np.array([vocab[bytes([b])] for b in range(256)], dtype=np.int64)
        none = np.iinfo(np.int64).max
        self._left = np.full(size, -1, dtype=np.int64)
        self._right = np.full(size, -1, dtype=np.int64)
        self._born = np.full(size, -1, dtype=np.int64)  # rank of the merge that makes the token
        self._size = np.int64(size)
        self._rank: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks, made_by = [], [], []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (bytes(stand_in[c] for c in part) for part in (merge.split(" ") if isinstance(merge, str) else merge))
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self._rank[x, y] = (rank, z)
            keys.append(x * size + y)
            ranks.append(rank)
            made_by.append(z)
            if self._born[z] < 0:
                self._left[z], self._right[z], self._born[z] = x, y, rank
        order = np.argsort(keys)
        self._keys, self._ranks = np.array(keys, dtype=np.int64)[order], np.array(ranks, dtype=np.int64)[order]
        self._made = np.array(made_by, dtype=np.int64)
        self._none = none
        self._pairs: dict[int, bool] = {}
        made = np.flatnonzero(self._born >= 0)
        whole = np.ones(size, dtype=bool)
        # a token may be proposed when its own bytes merge to it: its halves can be proposed and nothing joins them earlier
        for _ in range(40):
            fine = whole[self._left[made]] & whole[self._right[made]]
            fine &= self._compatible(self._left[made], self._right[made], below=self._born[made])
            before = whole[made].copy()
            whole[made] = fine
            if np.array_equal(before, fine):
                break
        self._plant({t: i for t, i in vocab.items() if whole[i]})
        self._cache: dict[int, bytes] = {}
        self._lengths = np.array([len(t) for t in self.text_of], dtype=np.int64)
        self._flat = np.frombuffer(b"".join(self.text_of), dtype=np.uint8)
        self._starts = np.concatenate([[0], np.cumsum(self._lengths)[:-1]])

    def _plant(self, tokens: dict[bytes, int]) -> None:
        """The trie of the tokens as sorted (node, byte) keys."""
        nodes: dict[tuple[int, int], int] = {}
        token_at = [-1]
        for token, i in tokens.items():
            node = 0
            for byte in token:
                new = nodes.setdefault((node, byte), len(token_at))
                if new == len(token_at):
                    token_at.append(-1)
                node = new
            token_at[node] = i
        keys = np.array([n * 256 + b for n, b in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self._trie_keys, self._trie_next = keys[order], np.array(list(nodes.values()), dtype=np.int64)[order]
        self._token_at = np.array(token_at, dtype=np.int64)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self._size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], self._none)

    def _edge(self, tokens: np.ndarray, side: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The states of a token's edge: (edge token, rank at which it is absorbed into the next larger one)."""
        out, current, until = [], tokens.copy(), np.full(len(tokens), self._none)
        while True:
            out.append((current.copy(), until.copy()))
            inner = np.where(current >= 0, side[current], -1)
            if (inner < 0).all():
                return out
            until = np.where(inner >= 0, self._born[current], 0)
            current = inner

    def _compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """True where no merge (of a rank under ``below``) joins the two tokens of a pair across their border.

        An edge state lives from its own merge until it is absorbed. A joining rule applies if its rank comes while both
        states live; at equal rank the merge further left goes first.
        """
        ok = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), self._none) if below is None else below
        lefts, rights = self._edge(a, self._right), self._edge(b, self._left)
        for x, x_until in lefts:
            for y, y_until in rights:
                live = np.flatnonzero((x >= 0) & (y >= 0) & ok)
                if not len(live):
                    continue
                rank = self._lookup(x[live], y[live])
                joins = (rank < x_until[live]) & (rank <= y_until[live]) & (rank < limit[live]) & (rank < self._none)
                ok[live[joins]] = False
        return ok

    def _propose(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once: (word number, token), in order.

        Every word walks down the trie of the vocabulary byte by byte; where no longer token can follow, the longest one
        passed is taken and the walk starts again behind it.
        """
        owners, tokens, turns = [], [], []
        word, at, turn = np.arange(len(offsets) - 1), offsets[:-1].copy(), 0
        while len(word):
            end = offsets[word + 1]
            node = np.zeros(len(word), dtype=np.int64)
            best, best_end = np.full(len(word), -1), at.copy()
            live, here = np.arange(len(word)), at.copy()
            while len(live):
                step = self._step(node[live], data[here[live]])
                fine = step >= 0
                live, step = live[fine], step[fine]
                node[live] = step
                here[live] += 1
                token = self._token_at[step]
                some = token >= 0
                best[live[some]], best_end[live[some]] = token[some], here[live[some]]
                live = live[here[live] < end[live]]
            owners.append(word)
            tokens.append(best)
            turns.append(np.full(len(word), turn))
            left = best_end < end
            word, at, turn = word[left], best_end[left], turn + 1
        owner, token, turn_of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, tokens, turns))
        order = np.lexsort((turn_of, owner))
        return owner[order], token[order]

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self._trie_keys, key), len(self._trie_keys) - 1)
        return np.where(self._trie_keys[at] == key, self._trie_next[at], -1)

    def _merge(self, data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging in many words at once: in each round every word joins all places of its lowest-ranked pair, from
        the left. Words without a rule that applies are done."""
        ids = self._byte_ids[data]
        done_owner, done_ids = [], []
        rank = self._ranks_beside(ids, owner)
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            lowest = np.repeat(least, size)
            active = lowest < self._none
            if not active.all():
                done_owner.append(owner[~active])
                done_ids.append(ids[~active])
                ids, owner, rank, lowest = ids[active], owner[active], rank[active], lowest[active]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == lowest)
            # places that touch, as in a run of one letter: every second one counts
            run = np.flatnonzero(np.append(True, np.diff(hits) != 1))
            lead = np.repeat(run, np.diff(np.append(run, len(hits))))
            hits = hits[(np.arange(len(hits)) - lead) % 2 == 0]
            ids[hits] = self._made[rank[hits]]
            keep = np.ones(len(ids), dtype=bool)
            keep[hits + 1] = False
            shift = np.cumsum(keep) - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            spots = shift[hits]
            near = np.unique(np.concatenate([spots, spots[spots > 0] - 1]))
            rank[near] = self._ranks_beside(ids, owner, near)
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return owner[order], ids[order]

    def _ranks_beside(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of the pair that starts at each place; none at the end of a word."""
        at = np.arange(len(ids)) if at is None else at
        out = np.full(len(at), self._none)
        inner = np.flatnonzero(at < len(ids) - 1)
        inner = inner[owner[at[inner]] == owner[at[inner] + 1]]
        out[inner] = self._lookup(ids[at[inner]], ids[at[inner] + 1])
        return out

    def _long_merge(self, word: bytes) -> list[int]:
        """The same for one long word, with a heap of pairs, so that the work does not grow with the square of it."""
        ids = self._byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank = self._rank
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(len(ids) - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if r := rank.get((made, ids[after[j]])):
                    heapq.heappush(heap, (r[0], i, made, ids[after[j]], r[1]))
            if before[i] >= 0 and (r := rank.get((ids[before[i]], made))):
                heapq.heappush(heap, (r[0], before[i], ids[before[i]], made, r[1]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of single words: propose all, verify all neighbouring pairs at once, merge the words that fail."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        offsets = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)), out=offsets[1:])
        owner, flat = self._propose(data, offsets)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[same] * self._size + flat[same + 1], return_inverse=True)
        fine = self._verified(pairs)
        failing = np.zeros(len(words), dtype=bool)
        failing[owner[same[~fine[back]]]] = True
        if failing.any():
            long = failing & (np.diff(offsets) >= LONG_WORD)
            short = failing & ~long
            of_byte = np.repeat(np.arange(len(words)), np.diff(offsets))
            take = short[of_byte]
            more_owner, more = self._merge(data[take], of_byte[take])
            keep = ~failing[owner]
            parts = [(owner[keep], flat[keep]), (more_owner, more)]
            for i in np.flatnonzero(long).tolist():
                ids = np.array(self._long_merge(words[i]), dtype=np.int64)
                parts.append((np.full(len(ids), i), ids))
            owner, flat = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(owner, kind="stable")
            owner, flat = owner[order], flat[order]
        raw = flat.astype("<u4").tobytes()
        ends = (np.searchsorted(owner, np.arange(len(words)), side="right") * 4).tolist()
        return [raw[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends)]

    def _verified(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each distinct pair is compatible; verdicts are kept."""
        known = self._pairs
        verdicts = list(map(known.get, pairs.tolist()))
        new = np.array([i for i, v in enumerate(verdicts) if v is None], dtype=np.int64)
        fine = np.array([bool(v) for v in verdicts], dtype=bool)
        if len(new):
            fine[new] = self._compatible(pairs[new] // self._size, pairs[new] % self._size)
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
            known.update(zip(pairs[new].tolist(), fine[new].tolist()))
        return fine

    def _fill(self, chunks: list[bytes], plain: list[bool]) -> list[bytes]:
        """Encodings of chunks, each a word with what touches it, or the mark of a special token. A plain one is one word."""
        cut = [[c] if p or c in self._marks else [w.encode() for w in self.words.findall(c.decode())] for c, p in zip(chunks, plain)]
        distinct = list(dict.fromkeys(itertools.chain.from_iterable(cut)))
        code = dict(zip(distinct, self.encode_words(distinct))) | self._marks
        look = code.__getitem__
        return [look(p[0]) if len(p) == 1 else b"".join(map(look, p)) for p in cut]

    def encode_column(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets) of the texts, piece by piece in order; null is the empty text."""
        for _, _, data, offsets in pieces(column, 2 * PIECE_BYTES):
            yield self._encode_piece(data, offsets)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for ids, offsets in self.encode_column(pa.array(texts, pa.large_string())):
            raw, at = ids.tobytes(), (offsets * 4).tolist()
            out += [raw[lo:hi] for lo, hi in itertools.pairwise(at)]
        return out

    def _encode_piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self._spans(data, offsets)
        keys, back = np.unique(span_hashes(data, starts, ends), return_inverse=True)
        at = np.zeros(len(keys), dtype=np.int64)
        at[back] = np.arange(len(back))
        keys = keys.tolist()
        found = list(map(self._cache.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            raw = data.tobytes()
            chunks = [raw[lo:hi] for lo, hi in zip(starts[at[missing]].tolist(), ends[at[missing]].tolist())]
            if len(self._cache) + len(chunks) > CACHE_WORDS:
                self._cache.clear()
            first = starts[at[missing]]
            odd = np.concatenate([[0], np.cumsum(KIND[data] == 3)])
            plain = odd[ends[at[missing]]] == odd[first + (data[first] == 0x20)]
            for i, ids in zip(missing, self._fill(chunks, plain.tolist())):
                found[i] = self._cache[keys[i]] = ids
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        first = np.cumsum(size) - size
        counts = size[back]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(first[back] - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, offsets)]

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that are encoded on their own. A single blank goes with the word behind it, a line end stands alone.
        In texts where blanks meet, other blanks occur or a special token is marked, the pattern cuts."""
        starts, ends, _ = words(data, offsets)
        after_blank = (starts > 0) & (data[starts - 1] == 0x20)
        after_blank &= ~np.isin(starts, offsets)
        lines = np.flatnonzero(data == 0x0A)
        begin = np.concatenate([starts - after_blank, lines])
        stop = np.concatenate([ends, lines + 1])
        begin, stop = self._by_kind(data, begin, stop)
        odd = np.flatnonzero(self._odd(data, offsets))
        if len(odd):
            keep = ~np.isin(np.searchsorted(offsets[1:], begin, side="right"), odd)
            parts_begin, parts_stop = [begin[keep]], [stop[keep]]
            for i in odd.tolist():
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                parts = self.marks.split(text) if self.marks else [text]
                cut = itertools.chain.from_iterable([p] if p in self.special else self.words.findall(p) for p in parts)
                upto = offsets[i] + np.cumsum([0, *(len(w.encode()) for w in cut)])
                parts_begin.append(upto[:-1])
                parts_stop.append(upto[1:])
            begin, stop = np.concatenate(parts_begin), np.concatenate(parts_stop)
        order = np.argsort(begin, kind="stable")
        return begin[order].astype(np.int64), stop[order].astype(np.int64)

    @staticmethod
    def _by_kind(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of letters, digits and marks only, cut where the kind changes; other chunks stay whole."""
        kind = KIND[data]
        other = np.concatenate([[0], np.cumsum(kind == 3)])
        first = begin + (data[begin] == 0x20)
        fine = (other[stop] == other[first]) & (first < stop)
        inside = np.zeros(len(data) + 2, dtype=np.int32)
        inside[first[fine] + 1] += 1  # chunks do not meet in a byte
        np.subtract.at(inside, stop[fine], 1)
        cuts = np.flatnonzero((np.cumsum(inside)[1 : len(data)] > 0) & (kind[1:] != kind[:-1])) + 1
        return np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([stop, cuts]))

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that the plain cut does not fit."""
        n = len(data)
        blank = (data == 0x20) | (data == 0x0A)
        at = [np.flatnonzero(blank[1:] & blank[:-1]), np.flatnonzero(OTHER_BLANK[data])]
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        lasts = np.append(filled[1:], n) - 1 if n else filled
        at += [filled[blank[filled]], lasts[blank[lasts]]]
        wide = np.flatnonzero(WIDE_LEAD[data])
        wide = wide[wide < n - 1]
        second = data[wide + 1]
        third = data[np.minimum(wide + 2, n - 1)]
        lead = data[wide]
        hit = (lead == 0xC2) & ((second == 0x85) | (second == 0xA0))
        hit |= (lead == 0xE1) & (second == 0x9A) & (third == 0x80)
        hit |= (lead == 0xE2) & (second == 0x80) & ((third <= 0x8A) | np.isin(third, [0xA8, 0xA9, 0xAF]))
        hit |= (lead == 0xE2) & (second == 0x81) & (third == 0x9F)
        hit |= (lead == 0xE3) & (second == 0x80) & (third == 0x80)
        at.append(wide[hit])
        raw = data.tobytes() if self._marks else b""
        for mark in self._marks:
            spot = raw.find(mark)
            while spot >= 0:
                at.append(np.array([spot]))
                spot = raw.find(mark, spot + len(mark))
        odd = np.zeros(len(offsets) - 1, dtype=bool)
        odd[np.searchsorted(offsets[1:], np.concatenate(at), side="right")] = True
        return odd

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a token sequence, invalid UTF-8 replaced as the library does."""
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        within = np.arange(total) - np.repeat(ends - lengths, lengths)
        raw = self._flat[np.repeat(self._starts[ids], lengths) + within].tobytes()
        return raw.decode("utf-8", errors="replace").encode()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per Python worker and file."""
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in C.split(batches, text):
            ids, counts = zip(*((i, np.diff(o)) for i, o in c.encode_column(batch.column(text))))
            counts = np.concatenate(counts)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype("<i4") * 4
            raw = pa.py_buffer(np.concatenate(ids).tobytes())
            yield C.extend(batch, {"ids": pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), raw]), "n_tokens": pa.array(counts)})

    return C.map_batches(docs, run, {"ids": "binary", "n_tokens": "long"})


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in C.split(batches, ids):
            found = [None if x is None else c.decode(np.frombuffer(x, dtype="<u4").astype(np.int64)).decode() for x in batch.column(ids).to_pylist()]
            yield C.extend(batch, {out: pa.array(found, pa.string())})

    return C.map_batches(encoded, run, {out: "string"})
