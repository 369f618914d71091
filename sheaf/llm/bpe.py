"""BPE by backtracking over longest matches: exact merges in linear time, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from os.path import commonprefix

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Unicode's White_Space, which separates words; Python's own notion also has U+001C to U+001F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
#: Bytes of text that are encoded together, and words that a generation of the cache holds.
PIECE, CACHED = 8 << 20, 100_000

# What the library's Unicode tables have beyond those of Python (15.1): letters and numbers of Unicode 16.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
# Lower case that the library knows and Python doesn't, as (first, last, first in lower case).
LOWER_17 = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
_LOWER: dict[int, int] = {c: to + c - a for a, b, to in LOWER_17 for c in range(a, b + 1)} | {ord("Σ"): ord("σ")}  # no word-final sigma
_OWN_LOWER = re.compile(f"[{''.join(map(chr, _LOWER))}]").search


@cache
def pieces_pattern() -> str:
    """What a word is cut into: contractions, runs of letters, single numbers, runs of other characters."""
    classes = {}
    for kind, more in (("L", LETTERS_16), ("N", NUMBERS_16)):
        found = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind]
        found = sorted({*found, *(c for a, b in more for c in range(a, b + 1))})
        runs = [[c for _, c in run] for _, run in groupby(enumerate(found), lambda x: x[1] - x[0])]
        classes[kind] = "".join(f"{re.escape(chr(run[0]))}-{re.escape(chr(run[-1]))}" for run in runs)
    letters, numbers = classes["L"], classes["N"]
    return f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, iter(range(256, 512))
    return [out[b] if b in out else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary with word ends, encoded without replaying merges.

    A word's text is unique in merge form: it is the one sequence of tokens whose every neighbouring pair would stay
    as it is if encoded alone. Longest matches are taken from the left; where the next pair isn't stable, the last
    token gives way to its longest proper prefix that is a token. Each position is left for good once it has failed.
    """

    def __init__(self, content: bytes, pattern: str | None = None, end: str = "</w>"):
        self.cut_word = re.compile(pattern or pieces_pattern()).findall
        spec = json.loads(content)
        model = spec["model"]
        if model.get("end_of_word_suffix") != end or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("a byte-level vocabulary with word ends is expected")
        self.end = end
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(_SPACES.search(t) for t in self.special):
            raise ValueError("special tokens with white space are not supported")
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        ids: dict[str, int] = model["vocab"]
        self.ids = ids
        #: A token's rank is the place of the merge that makes it; single symbols come before all merges.
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        for place, (a, b) in enumerate(model["merges"]):
            token = ids[a + b]
            if token not in self.rank:
                self.rank[token], self.halves[token] = place, (ids[a], ids[b])
            self.made[ids[a], ids[b]] = place
        self._whole: dict[tuple[int, int], bool] = {}
        #: A word's last symbol carries the end mark; here that mark is one more character, so texts match as strings.
        self.text = {i: t[: -len(end)] + "\0" if t.endswith(end) and t != end else t for t, i in ids.items()}
        self.trie = ahocorasick.Automaton()
        reachable = [i for i in self.text if i in self.halves or len(self.text[i].rstrip("\0")) == 1]
        for i in reachable:
            self.trie.add_word(self.text[i], i)
        self.trie.make_automaton()
        self.match = {self.text[i]: i for i in reachable}
        self.longest = max(map(len, self.match))
        #: For each token the longest one that is a proper beginning of it, or -1.
        self.shorter = {i: next((self.match[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.match), -1) for t, i in self.match.items()}
        self.length = {i: len(t) for t, i in self.match.items()}
        self.direct = {self.text[i][:-1]: i for i in reachable if self.text[i].endswith("\0")}
        self.chars = byte_chars()
        #: The texts of all tokens in one string, and where each begins.
        top = 1 + max([*ids.values(), *self.special.values()])
        texts = [""] * top
        for t, i in [*ids.items(), *self.special.items()]:
            texts[i] = t
        self.blob = "".join(texts)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).tolist()
        self._cache: dict[str, tuple[bytes, str]] = {}
        self._older: dict[str, tuple[bytes, str]] = {}
        self._pieces: dict[str, list[int]] = {}
        self._older_pieces: dict[str, list[int]] = {}
        self._mark = commonprefix(list(self.special))

    def stable(self, left: int, right: int) -> bool:
        """Whether the merges of left + right end in exactly this pair.

        It isn't, if some pair of parts that meet at the boundary merges before the parts themselves are complete.
        Parts at the boundary are undone in the reverse order of their merges, which is the order of time.
        """
        if len(self._whole) > 1 << 18:
            self._whole.clear()
        self._whole[left, right] = found = self._stable(left, right)
        return found

    def _stable(self, left: int, right: int) -> bool:
        rank, halves, made = self.rank, self.halves, self.made
        # the merge that swallows the part at the boundary, on either side; of equal ranks the leftmost goes first
        until_left = until_right = len(made) + 1
        while True:
            across = made.get((left, right))
            if across is not None and across < until_left and across <= until_right:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                until_left, left = a, halves[left][1]
            else:
                until_right, right = b, halves[right][0]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as byte characters without the end mark."""
        whole = self.direct.get(piece)
        if whole is not None:
            return [whole]
        text = piece + "\0"
        last = len(text) - 1  # a match may not stop here: the end mark alone is no token
        known, stable, length = self._whole, self.stable, self.length
        out: list[int] = []
        pos, prev = 0, -1
        for end, token in self.trie.iter_long(text):  # the longest match at every place
            if prev >= 0:
                ok = known.get((prev, token))
                if not (stable(prev, token) if ok is None else ok):
                    break
            out.append(token)
            pos, prev = end + 1, token
        else:
            if pos > last:
                return out
            token = -1  # only the end mark is left
        dead: set[int] = set()
        if token >= 0:
            token = self.shorter[token]
        while pos <= last:
            prev = out[-1] if out else -1
            while token >= 0:
                end = pos + length[token]
                if end != last and end not in dead:
                    if prev < 0:
                        break
                    ok = known.get((prev, token))
                    if stable(prev, token) if ok is None else ok:
                        break
                token = self.shorter[token]
            else:
                if not out:
                    raise ValueError(f"no encoding of {piece!r}")
                dead.add(pos)
                token = out.pop()
                pos -= length[token]
                token = self.shorter[token]
                continue
            out.append(token)
            pos = end
            if pos <= last:
                token = self._longest(text, pos)
        return out

    def _longest(self, text: str, pos: int) -> int:
        """The longest token that the text has at a place."""
        part = text[pos : pos + self.longest]
        for n in range(self.trie.longest_prefix(part), 0, -1):
            found = self.match.get(part[:n])
            if found is not None:
                return found
        return -1

    def encode_word(self, word: str) -> list[int]:
        """Ids of a text without white space or special tokens."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
            if _OWN_LOWER(word):
                word = word.translate(_LOWER)
        word = word.lower()
        if word.isalpha():
            return self._piece(word)
        ids: list[int] = []
        for piece in self.cut_word(word):
            ids += self._pieces.get(piece) or self._piece(piece)
        return ids

    def _piece(self, piece: str) -> list[int]:
        """encode_piece with a cache, whose two generations bound the memory."""
        found = self._pieces.get(piece)
        if found is None:
            found = self._older_pieces.get(piece) or self.encode_piece("".join([self.chars[b] for b in piece.encode()]))
            if len(piece) <= 64:
                if len(self._pieces) >= CACHED:
                    self._older_pieces, self._pieces = self._pieces, {}
                self._pieces[piece] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by single spaces, as there is no decoder that undoes word ends."""
        blob, at = self.blob, self.offsets
        return " ".join([blob[at[i] : at[i + 1]] for i in ids])

    def encode_run(self, run: str) -> list[int]:
        """Ids of a text without ASCII white space: special tokens and other white space divide it further."""
        if self._mark not in run or not self.special:
            if run.isascii() or not _SPACES.search(run):
                return self.encode_word(run)
            segments = [run]
        else:
            segments = self._cut.split(run)
        ids: list[int] = []
        for segment in segments:
            if segment in self.special:
                ids.append(self.special[segment])
                continue
            for word in _SPACES.split(segment):
                ids += self.encode_word(word)
        return ids

    def _known(self, run: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text. Two generations of the cache bound the memory."""
        found = self._cache.get(run) or self._older.get(run)
        if found is None:
            ids = self.encode_run(run)
            found = struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)
        if len(run) <= 64:
            if len(self._cache) >= CACHED:
                self._older, self._cache = self._cache, {}
            self._cache[run] = found
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all texts one after another, how many each text has, and the decoded texts.

        Each different run of the texts is encoded and decoded once.
        """
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        owner, runs = pc.list_parent_indices(parts).to_numpy(), parts.flatten().dictionary_encode()
        cache = self._cache
        found = []
        for run in runs.dictionary.to_pylist():
            found.append(cache.get(run) or self._known(run))
            cache = self._cache
        sizes = np.fromiter((len(f[0]) for f in found), np.int64, len(found))
        at = runs.indices.to_numpy()
        real = np.flatnonzero(sizes[at] > 0)  # empty runs at the ends of texts, or of rare white space alone
        owner, at = owner[real], at[real]
        where = pa.array(at)
        taken = pa.array([f[0] for f in found], pa.binary()).take(where)
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4")[: int(sizes[at].sum()) // 4] if len(at) else np.empty(0, "<u4")
        counts = np.bincount(owner, sizes[at] // 4, len(texts)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
        decoded = pa.ListArray.from_arrays(pa.array(ends), pa.array([f[1] for f in found], pa.string()).take(where))
        return ids, counts, pc.binary_join(decoded, " ")


_LOADED: dict[str, Bpe] = {}


def loaded(content: bytes, digest: str, pattern: str) -> Bpe:
    """The one Bpe of a process, which outlives a task."""
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = Bpe(content, pattern)
    return _LOADED[digest]


def _cut_by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about PIECE bytes of text, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    cuts = (np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // PIECE)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def encode(rows: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """rows (row, text) as row and ids, decoded; with digests instead n_tokens, ids_sha256, decoded_sha256.

    The driver reads the vocabulary file and broadcasts its content. Null text counts as empty and has no ids.
    """
    with open(vocabulary, "rb") as f:
        content = f.read()
    shared = rows.sparkSession.sparkContext.broadcast((content, hashlib.sha256(content).hexdigest(), pieces_pattern()))
    if digests:
        more = [("n_tokens", pa.int64(), T.LongType()), ("ids_sha256", pa.string(), T.StringType()), ("decoded_sha256", pa.string(), T.StringType())]
    else:
        more = [("ids", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())), ("decoded", pa.string(), T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(*shared.value)
        for whole in batches:
            for batch in _cut_by_size(whole):
                ids, counts, decoded = bpe.encode(batch.column(1))
                ends = np.concatenate([[0], np.cumsum(counts)])
                if digests:
                    raw, spans = memoryview(ids).cast("B") if len(ids) else b"", (4 * ends).tolist()
                    own = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(spans, spans[1:])]
                    back = [hashlib.sha256(t.encode()).hexdigest() for t in decoded.to_pylist()]
                    arrays = [pa.array(counts), pa.array(own, pa.string()), pa.array(back, pa.string())]
                else:
                    arrays = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view("<i4"))), decoded]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", *[name for name, _, _ in more]])

    schema = T.StructType([rows.schema["row"], *[T.StructField(name, kind) for name, _, kind in more]])
    return rows.select("row", "text").mapInArrow(run, schema)


def encode_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """One row per input row: doc_id and what `encode` adds.

    Null and empty texts have no ids. Identifiers may be null or repeat; other columns are ignored. An empty table
    gives an empty result.
    """
    rows = docs.select(docs[id_col].alias("row"), docs[text_col].alias("text"))
    return encode(rows, vocabulary, digests).withColumnRenamed("row", "doc_id")
