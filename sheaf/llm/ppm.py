"""Language-model scores by prediction by partial matching over bytes.

A word's first HEAD bytes are expected after the end of the word before, byte by byte; its rest is then taken as one
symbol of what followed this beginning, or, by an escape, byte by byte again.

All contexts of the training documents count, however rare. Contexts of up to ROOT bytes are broadcast; longer ones are dealt
out by their last ROOT + 1 bytes, and every symbol is scored where the contexts are that it can meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.scratch import drop, save

#: Longest context in bytes. A context doesn't reach beyond the last TAIL bytes of the word before.
ORDER, HEAD, TAIL = 7, 4, 3
#: Contexts of up to so many bytes are broadcast: there are at most 256 to that power, whatever the corpus.
ROOT = 2
#: Scores of beginnings and words rarer than this share of all are joined with the documents; at most 1 / share of either
#: can reach it, which bounds what is broadcast. Both ways give the same scores.
CODE_SHARE = 2.0**-21
WORD_SHARE = 2.0**-20
#: Longer words are never in the broadcast table.
LONGEST = 64
#: The symbols that end a word and a text; neither can be within a word.
GAP, END = 0x20, 0x0A
#: Bytes of text that are looked at together.
PIECE = 8 << 20


def held_out(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _low(n: int) -> np.uint64:
    """The mask of n bytes."""
    return np.uint64((1 << (8 * n)) - 1)


@dataclass
class Words:
    """Byte strings one after another: string i is data[ends[i] - sizes[i] : ends[i]]. NUL counts as U+0001."""

    data: np.ndarray
    sizes: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, array: pa.Array) -> Words:
        if not len(array):
            return cls(np.full(1, GAP, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64))
        offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        raw = array.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        data = np.append(np.maximum(data, 1), np.uint8(GAP))
        return cls(data, np.diff(offsets), offsets[1:] - offsets[0])


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, with A-Z in lower case, and how many each text has. A null text has none."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # just the six characters of ASCII
    words, owner = parts.flatten(), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(words), 0)
    words, owner = words.filter(real).cast(pa.binary()), owner.filter(real).to_numpy()
    return words, np.bincount(owner, minlength=len(texts))


def beginnings(words: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """For each word, and the end of each text after its words, a number of eight bytes: its first symbols and what they follow.

    The last TAIL bytes of the word before, a gap, and HEAD bytes, with the gap that ends the word; zero where there is
    less. A text's first word follows nothing.
    """
    w = Words.of(words)
    stops = np.cumsum(lengths)  # an end comes before the word of this number
    sizes, ends = np.insert(w.sizes, stops, 0), np.insert(w.ends, stops, 0)
    stop = sizes == 0
    starts = ends - sizes
    before = np.concatenate([[0], sizes[:-1]])[: len(sizes)]
    last = np.concatenate([[0], ends[:-1]])[: len(sizes)]
    code = np.zeros(len(sizes), np.uint64)
    for k in range(TAIL, 0, -1):
        code = (code << np.uint64(8)) | np.where(before >= k, w.data[np.maximum(last - k, 0)], 0).astype(np.uint64)
    code = (code << np.uint64(8)) | np.uint64(GAP)
    for k in range(HEAD):
        inside = w.data[np.minimum(starts + k, len(w.data) - 1)]
        symbol = np.where(k < sizes, inside, np.where(k == sizes, GAP, 0))
        if k == 0:
            symbol = np.where(stop, END, symbol)
        code = (code << np.uint64(8)) | symbol.astype(np.uint64)
    return code


def of_beginnings(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of beginnings: the eight bytes that end in each, the length of its context, and whose it is."""
    tail = sum(((codes >> np.uint64(8 * (HEAD + 1 + k))) & np.uint64(255) > 0).astype(np.int64) for k in range(TAIL))
    out = []
    for k in range(HEAD):
        code = codes >> np.uint64(8 * (HEAD - 1 - k))
        real = np.flatnonzero(code & np.uint64(255))
        out.append((code[real], tail[real] + 1 + k, real))
    code, place, owner = (np.concatenate(x) for x in zip(*out, strict=True))
    return code, place, owner


def of_rests(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the symbols of words after their beginnings; the last is the gap."""
    w = Words.of(words)
    symbols = np.maximum(0, w.sizes - HEAD + 1)
    owner = np.repeat(np.arange(len(symbols)), symbols)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(symbols) - symbols, symbols) + HEAD + 1  # the gap before the word is at 0
    start, size = (w.ends - w.sizes)[owner], w.sizes[owner]
    code = np.zeros(len(owner), np.uint64)
    for back in range(ORDER, -1, -1):
        at = place - back
        byte = np.where((at == 0) | (at > size), GAP, w.data[np.clip(start + at - 1, 0, len(w.data) - 1)])
        code = (code << np.uint64(8)) | np.where(at < 0, 0, byte).astype(np.uint64)
    return code, np.minimum(place, ORDER), owner


def places_of(grams: np.ndarray) -> np.ndarray:
    """The lengths of the contexts: no byte of a sequence is zero."""
    return sum((grams >> np.uint64(8 * k) > 0).astype(np.int64) for k in range(1, ORDER + 1))


@dataclass
class Level:
    """Counts of symbols after contexts of one length, and what escapes and exclusions need."""

    grams: np.ndarray  # context and symbol
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    #: The same of the next shorter context, without the symbols that follow this one.
    rest_totals: np.ndarray
    rest_kinds: np.ndarray


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in a sorted table, -1 for what isn't in it."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


@dataclass
class Trie:
    levels: list[Level]

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray, lengths: range, shorter: list[Level] | None = None) -> Trie:
        """Contexts of these lengths after those of `shorter`, from the longest sequence at each symbol."""
        levels = list(shorter or [])
        seen = counts > 0
        longest, weights, places = grams[seen], counts[seen], places_of(grams[seen])
        for k in lengths:
            mine = places >= k
            g, which = np.unique(longest[mine] & _low(k + 1), return_inverse=True)
            c = np.bincount(which, weights[mine], len(g)).astype(np.int64)
            contexts, at = np.unique(g >> np.uint64(8), return_inverse=True)
            totals = np.bincount(at, c, len(contexts)).astype(np.int64)
            kinds = np.bincount(at, minlength=len(contexts))
            rest_totals, rest_kinds = np.zeros_like(totals), np.zeros_like(kinds)
            if k and len(g):  # what follows a longer context follows a shorter one
                less = levels[-1]
                taken = np.bincount(at, less.counts[_find(less.grams, g & _low(k))], len(contexts)).astype(np.int64)
                back = _find(less.contexts, contexts & _low(k - 1))
                rest_totals, rest_kinds = less.totals[back] - taken, less.kinds[back] - kinds
            levels.append(Level(g, c, contexts, totals, kinds, rest_totals, rest_kinds))
        return cls(levels)

    def score(self, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol.

        Escape method C. A symbol that a longer context offers isn't expected from a shorter one; since contexts are
        nested, what is excluded is exactly what followed the context that was tried just before.
        """
        out = np.zeros(len(code))
        open_, n, d = np.arange(len(code)), np.zeros(len(code)), np.zeros(len(code))
        fresh = np.ones(len(code), bool)  # no context of the symbol has been known so far
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            tried = open_[place[open_] >= k]
            if not len(tried) or not len(level.contexts):
                continue
            part = code[tried] & _low(k + 1)
            at = _find(level.contexts, part >> np.uint64(8))
            tried, part, at = tried[at >= 0], part[at >= 0], at[at >= 0]
            first = fresh[tried]
            total = np.where(first, level.totals[at], n[tried])
            kinds = np.where(first, level.kinds[at], d[tried])
            fresh[tried] = False
            gram = _find(level.grams, part)
            hit = gram >= 0
            out[tried[hit]] += np.log10(level.counts[gram[hit]] / (total[hit] + kinds[hit]))
            miss = tried[~hit]
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.log10(kinds[~hit] / (total[~hit] + kinds[~hit]))
            out[miss] += np.where(kinds[~hit] > 0, escape, 0.0)
            n[miss], d[miss] = level.rest_totals[at[~hit]], level.rest_kinds[at[~hit]]
            done = np.zeros(len(code), bool)
            done[tried[hit]] = True
            open_ = open_[~done[open_]]
        seen = len(self.levels[0].grams)
        out[open_] -= log10(256 - seen) if seen < 256 else 0.0
        return out


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about PIECE bytes of text, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // PIECE)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def _summed(words: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    found = pa.chunked_array(words).combine_chunks().dictionary_encode()
    c = np.bincount(found.indices.to_numpy(), np.concatenate(counts), len(found.dictionary))
    return found.dictionary, c.astype(np.int64)


def _counted(docs: DataFrame) -> DataFrame:
    """word, code, c: all words (b"" for ends of texts) and beginnings, and how often they occur in training documents."""

    def batches_of(word: pa.Array, code: pa.Array, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(c), 50_000):
            yield pa.RecordBatch.from_arrays([x.slice(at, 50_000) for x in (word, code, pa.array(c))], ["word", "code", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codes, texts = ([], []), ([], []), 0

        def flush() -> Iterator[pa.RecordBatch]:
            if words[0]:
                found, c = _summed(*words)
                yield from batches_of(found, pa.nulls(len(found), pa.int64()), c)
            if codes[0]:
                found, which = np.unique(np.concatenate(codes[0]), return_inverse=True)
                c = np.bincount(which, np.concatenate(codes[1]), len(found)).astype(np.int64)
                yield from batches_of(pa.nulls(len(found), pa.binary()), pa.array(found.view(np.int64)), c)
            for x in (*words, *codes):
                x.clear()

        for whole in batches:
            for batch in _pieces(whole):
                hidden = np.array([held_out(d) for d in batch.column(0).to_pylist()], bool)
                texts += int((~hidden).sum())
                for mine, weight in ((~hidden, 1), (hidden, 0)):
                    found, lengths = tokenised(batch.column(1).filter(pa.array(mine)))
                    encoded = found.dictionary_encode()
                    words[0].append(encoded.dictionary)
                    words[1].append(weight * np.bincount(encoded.indices.to_numpy(), minlength=len(encoded.dictionary)))
                    begun, c = np.unique(beginnings(found, lengths), return_counts=True)
                    codes[0].append(begun)
                    codes[1].append(weight * c)
                if sum(map(len, codes[0])) > 2_000_000 or sum(map(len, words[0])) > 1_000_000:
                    yield from flush()
        yield from flush()
        yield from batches_of(pa.array([b""] if texts else [], pa.binary()), pa.nulls(min(1, texts), pa.int64()), np.full(min(1, texts), texts))

    return docs.mapInArrow(run, "word binary, code long, c long").groupBy("word", "code").agg(F.sum("c").alias("c"))


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows word, code, c, h: whether it is a rest, the longest sequence at each symbol, what it counts, and whose it is.

    Beginnings count as often as they occur. The rest of a word counts once, as it is only spelt when it is new.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, 50_000):
            batch = whole.slice(at, 50_000)
            is_code = batch.column(1).is_valid()
            of_codes, of_words = batch.filter(is_code), batch.filter(pc.invert(is_code))
            codes = of_codes.column(1).to_numpy().astype(np.int64)
            code, _, owner = of_beginnings(codes.view(np.uint64))
            yield False, code, of_codes.column(2).to_numpy()[owner], codes[owner]
            code, _, owner = of_rests(of_words.column(0))
            yield True, code, (of_words.column(2).to_numpy() > 0)[owner].astype(np.int64), of_words.column(3).to_numpy()[owner]


def _roots(counted: DataFrame) -> dict[bool, list[Level]]:
    """The contexts of up to ROOT bytes, of beginnings and of rests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}

        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(which, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)

        for rest, code, c, _ in _spelt(batches):
            found[rest] = [summed([*found[rest], (code & _low(ROOT + 1), c)])]
        for rest, parts in found.items():
            for grams, c in parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), rest)), pa.array(grams.view(np.int64)), pa.array(c)], ["rest", "gram", "c"])

    rows = counted.mapInArrow(run, "rest boolean, gram long, c long").groupBy("rest", "gram").agg(F.sum("c").alias("c")).toArrow()
    rest, gram, c = rows["rest"].to_numpy(), rows["gram"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    return {kind: Trie.of(gram[rest == kind], c[rest == kind], range(ROOT + 1)).levels for kind in (False, True)}


def _scored(counted: DataFrame) -> DataFrame:
    """rest, h, s: log10 of the probability of each beginning (h is its code) and of the rest of each word (h is its hash), byte by byte.

    A symbol goes where all contexts that end in the same ROOT + 1 bytes are: the longer ones that it can meet are there, the
    shorter ones everywhere.
    """
    names = ["rest", "gram", "c", "h"]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, code, c, owner in _spelt(batches):
            for at in range(0, len(code), 50_000):
                part = slice(at, at + 50_000)
                arrays = [np.full(len(code[part]), rest), code[part].view(np.int64), c[part], owner[part]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)

    shared = counted.sparkSession.sparkContext.broadcast(_roots(counted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[x.to_numpy(zero_copy_only=False) for x in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        rest, gram, c, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        for kind in (False, True):
            mine = np.flatnonzero(rest == kind)
            grams, which = np.unique(gram[mine].view(np.uint64), return_inverse=True)
            trie = Trie.of(grams, np.bincount(which, c[mine], len(grams)), range(ROOT + 1, ORDER + 1), shared.value[kind])
            score = trie.score(grams, places_of(grams))[which]
            owners, which = np.unique(owner[mine], return_inverse=True)
            s = np.bincount(which, score, len(owners))
            for at in range(0, len(owners), 50_000):
                part = slice(at, at + 50_000)
                arrays = [np.full(len(owners[part]), kind), owners[part], s[part]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["rest", "h", "s"])

    symbols = counted.mapInArrow(spell, "rest boolean, gram long, c long, h long")
    last = F.shiftright("gram", 8).bitwiseAND((1 << (8 * (ROOT + 1))) - 1)
    dealt = symbols.repartition(last, "rest")
    return dealt.mapInArrow(run, "rest boolean, h long, s double").groupBy("rest", "h").agg(F.sum("s").alias("s"))


def _known(counted: DataFrame, log_rest: float) -> DataFrame:
    """rest, h, word, trained, base, score: what each word (rest), and each beginning, adds to the scores of a text."""
    scored = save(_scored(counted), "scored")
    words = counted.filter("word is not null").select("h", "word", "c", F.when(F.length("word") >= HEAD, F.substring("word", 1, HEAD)).alias("head"))
    heads = words.filter("c > 0 and head is not null").groupBy("head").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"))
    words = words.join(scored.filter("rest").select("h", "s"), "h", "left").join(heads, "head", "left")
    p = F.coalesce("s", F.lit(0.0))
    escaped = F.log10("d") + p
    new = F.when(F.col("c") > 0, F.log10(F.col("c") + F.pow(F.lit(10.0), escaped))).otherwise(escaped)
    score = F.when(F.col("d").isNull(), p).otherwise(new - F.log10(F.col("n") + F.col("d")))
    words = words.select(F.lit(True).alias("rest"), "h", "word", F.col("c").alias("trained"), (F.log10(F.col("c") + 0.5) - log_rest).alias("base"), score.alias("score"))
    begun = counted.filter("code is not null").select(F.col("code").alias("h"), "c").join(scored.filter("not rest").select("h", "s"), "h")
    begun = begun.select(F.lit(False).alias("rest"), "h", F.lit(None).cast("binary").alias("word"), F.col("c").alias("trained"), F.lit(0.0).alias("base"), F.col("s").alias("score"))
    out = save(words.unionAll(begun), "known")
    drop(scored)
    return out


@dataclass
class Model:
    #: Frequent words and what they add to the scores, and the same of the end; frequent beginnings, sorted, and their scores.
    words: pa.Array
    base: np.ndarray
    word_score: np.ndarray
    end_known: bool
    end_base: float
    codes: np.ndarray
    code_score: np.ndarray

    def score(self, batch: pa.RecordBatch, uid: int) -> pa.RecordBatch:
        """One row for each document (doc_id, text) with what is known, and one for each word and beginning of it that isn't frequent."""
        words, lengths = tokenised(batch.column(1))
        size = batch.num_rows

        def counted(owner: np.ndarray, which: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            pairs, c = np.unique(owner * max(1, kinds) + which, return_counts=True)
            return pairs // max(1, kinds), pairs % max(1, kinds), c

        encoded = words.dictionary_encode()
        names = encoded.dictionary
        doc, name, c = counted(np.repeat(np.arange(size), lengths), encoded.indices.to_numpy(), len(names))
        at = pc.fill_null(pc.index_in(names, self.words), -1).to_numpy()
        found = at[name] >= 0
        hit = at[name[found]]
        n_known = np.bincount(doc[found], c[found], size).astype(np.int64) + self.end_known
        base = np.bincount(doc[found], c[found] * self.base[hit], size) + self.end_base
        score = np.bincount(doc[found], c[found] * self.word_score[hit], size).astype(float)  # of nothing it is whole numbers
        places = np.flatnonzero(at < 0)
        hashes = np.zeros(len(names), np.uint64)
        hashes[places] = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in names.take(pa.array(places)).to_pylist()), np.uint64, len(places))
        rare = [(doc[~found], hashes[name[~found]].view(np.int64), c[~found])]

        begun, which = np.unique(beginnings(words, lengths), return_inverse=True)
        at = _find(self.codes, begun)
        owner, found = np.repeat(np.arange(size), lengths + 1), at[which] >= 0
        score += np.bincount(owner[found], self.code_score[at[which[found]]], size)
        doc, name, c = counted(owner[~found], which[~found], len(begun))
        rare.append((doc, begun[name].view(np.int64), c))

        own = np.fromiter((xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) for i in range(uid, uid + size)), np.uint64, size)
        rest = np.concatenate([np.ones(size, bool), np.ones(len(rare[0][0]), bool), np.zeros(len(doc), bool)])
        doc, h, c = (np.concatenate(x) for x in zip(*rare, strict=True))
        ids = pa.concat_arrays([batch.column(0), pa.nulls(len(doc), batch.column(0).type)])

        def column(of_documents: np.ndarray, of_rare: np.ndarray | None = None) -> pa.Array:
            return pa.array(np.concatenate([of_documents, np.zeros(len(doc), of_documents.dtype) if of_rare is None else of_rare]))

        arrays = [
            pa.array(rest),
            column(own.view(np.int64), h),  # the document's own row: any word will do, as it is taken no times
            column(uid + np.arange(size), uid + doc),
            ids,
            column(np.zeros(size, np.int64), c.astype(np.int64)),
            column(lengths + 1),
            column(n_known),
            column(base),
            column(score),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["rest", "h", "uid", "doc_id", "c", "n", "n_known", "base", "score"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts cover all training documents, and no context, word or beginning is left out. A word's probability is that of its
    first bytes after the word before, times (c + d p) / (n + d): n words, d of them distinct, began like this in training,
    c were this one, and p is the probability of the rest, byte by byte. Every distinct beginning and word is scored once.
    The scores of frequent ones, of which there can be at most 1 / CODE_SHARE and 1 / WORD_SHARE, are broadcast; the others
    are summed by document and joined with the table of scores, words by a 64-bit hash.

    Null and empty texts hold one token, the end. Null identifiers count as empty texts for the choice of training
    documents; identifiers may repeat; other columns are ignored. Without any training document, there are no contexts and
    all symbols are equally likely. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = save(_counted(docs).withColumn("h", F.xxhash64("word")), "counted")
    word, c = F.col("word").isNotNull(), F.col("c")
    sums = counted.agg(F.sum(F.when(word, c)), F.sum((word & (c > 0)).cast("long")), F.sum(F.when(F.length("word") == 0, c)), F.sum(F.when(~word, c)))
    total, distinct, ends, begun = (x or 0 for x in sums.first())
    log_rest = log10(total + 0.5 * (distinct + 1))
    known = _known(counted, log_rest)
    drop(counted)
    frequent = known.filter((F.length("word") <= LONGEST) & (F.col("trained") >= max(1, total * WORD_SHARE))).select("word", "base", "score").toArrow()
    codes = known.filter(~F.col("rest") & (F.col("trained") >= max(1, begun * CODE_SHARE))).select("h", "score").toArrow()
    names = frequent["word"].combine_chunks() if len(frequent) else pa.array([], pa.binary())
    code, by_code = codes["h"].to_numpy().astype(np.int64).view(np.uint64), codes["score"].to_numpy()
    order = np.argsort(code)
    end_base = log10(ends + 0.5) - log_rest
    model = Model(names, frequent["base"].to_numpy(), frequent["score"].to_numpy(), ends > 0, end_base, code[order], by_code[order])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in _pieces(whole):
                yield shared.value.score(batch, uid)
                uid += batch.num_rows

    rows = docs.mapInArrow(
        run, f"rest boolean, h long, uid long, doc_id {kind}, c long, n long, n_known long, base double, score double"
    )
    adds = known.groupBy("rest", "h").agg(F.sum("trained").alias("trained"), F.first("base").alias("b"), F.first("score").alias("s"))
    joined = rows.join(adds, ["rest", "h"], "left")
    hidden = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1

    def added(x: str) -> Column:
        return F.col("c") * F.coalesce(x, F.lit(0.0))

    return (
        joined.groupBy("uid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("n").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(F.col("rest") & (F.col("trained") > 0), F.col("c")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + added("b")).alias("base_score"),
            F.sum(F.col("score") + added("s")).alias("score"),
        )
        .select(
            "doc_id", hidden.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
        )
    )
