"""Alignment of two tokenizers: token groups between common byte offsets, links within them, and corpus-wide counts of id pairs.

The steps are those of a relational plan: tokens in a row with their byte lengths, running sums of lengths, an equi-join of the
two sides' ends, running counts of the cuts as group ids, and a join of both sides by group.  ``relational`` is that plan in
DataFrames (posexplode, windows, joins).  Two tokenizers make some 800,000 token rows of each MB of text, many times
the input once shuffled (see README for figures), so that whole tables take the same steps as sums, sorted intersections and
gathers of numpy arrays within Arrow batches (``Aligner.align``), once for each distinct piece of text in reach of a task.  A
piece ends before a space between two characters that are surely no white space: neither tokenizer has tokens across it.

Counts of pairs over all documents are grouped in Spark from each task's sums, and kept as sorted arrays by A id in the shared
folder, which the tasks of the second reading map into memory.  They are at most as many as A ids times B ids, however long the
corpus.  Nothing is collected.

Defined cases.  Null and empty texts, and texts whose joined tokens of either side aren't a space and the text, have no tokens: zeros,
and '' for the digest.  Every row is a document of its own, under repeated and null ids too.  Strings of special tokens are plain text.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from customsloom.llm.common import atomic_save, bounded_batches, mounted, new_folder

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters that surely aren't white space for either tokenizer, nor the sign that stands for a space.
_SPACES = "".join(map(chr, [0x1680, 0x180E, *range(0x2000, 0x2070), 0x2581, 0x3000, 0xFEFF]))
_SOLID = rf"[^\s\x00-\x20\x7f-\xa0{_SPACES}]"
PIECES = re.compile(f"(?<={_SOLID}) (?={_SOLID})")
#: Distinct pieces that a worker remembers, and characters of text that are aligned at once.
REMEMBERED, RUN_CHARS = 400_000, 1 << 19
#: Pieces that are encoded as one text.
TOGETHER = 8_192
#: Pairs that a counting task gathers before it combines them.
COMBINE = 2_000_000
#: Files of pair counts, by A id.
SHARDS = 256
#: Pieces that may be encoded as one text, and by the plain merge loop: short, and of characters on which all versions of Unicode agree.
_PLAIN = re.compile(rf"[\x21-\x7e{chr(0xA1)}-{chr(0x24F)}]{{1,200}}")
#: How A splits a text before merging.  Fixed value of its file format.
_PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOW = 26  # bits of an id


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in A's entries: itself if printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Both tokenizers, loaded once a process."""

    _loaded: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        signs = _byte_signs()
        entries = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (entries[-1][1] + 1)
        for word, i in entries:
            self.a_bytes[i] = word.encode() if word in special else bytes(signs[c] for c in word)
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("\u2581", " ").encode() for i in range(n)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = ([str(i) for i in range(len(y))] for y in (self.a_bytes, self.b_bytes))
        with open(a_path, encoding="utf-8") as f:
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.load(f)["model"]["merges"]]
        order = [self.a.token_to_id(x + y) for x, y in merges]
        ranks = {self.a_bytes[i]: i for w, i in entries if w not in special}
        # a loop over ranks merges alike only if ids rise in the order of the merges
        self.plain = tiktoken.Encoding("a", pat_str=_PRETOKEN, mergeable_ranks=ranks, special_tokens={}) if order == sorted(order) and len(ranks) == 256 + len(order) else None

    @classmethod
    def of(cls, paths: tuple[str, str]) -> Aligner:
        if paths not in cls._loaded:
            cls._loaded[paths] = cls(*paths)
        return cls._loaded[paths]

    def tokens_a(self, texts: list[str]) -> list[list[int]]:
        """Of a space and each text."""
        return [e.ids for e in self.a.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]

    def tokens_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)

    def whole(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether both sides' bytes are a space and the text."""
        at, bt = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        return np.fromiter((b"".join(map(at, x)) == b" " + t.encode() == b"".join(map(bt, y)) for x, y, t in zip(a, b, texts, strict=True)), bool, len(texts))

    def _joined(self, pieces: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None:
        """(ids, tokens of each piece) of both sides for plain pieces, encoded as one text; None if that isn't their bytes."""
        text = " ".join(pieces)
        want = b" " + text.encode()
        ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in pieces), np.int64, len(pieces)))
        out = []
        for ids, words, size in ((self.plain.encode_ordinary(f" {text}"), self.a_bytes, self.a_size), (self.b.encode(text), self.b_bytes, self.b_size)):
            if b"".join(map(words.__getitem__, ids)) != want:
                return None
            ids = np.array(ids, np.int64)
            last = np.searchsorted(np.cumsum(size[ids]), ends)
            out.append((ids, np.diff(np.concatenate([[-1], last]))))
        return out[0], out[1]

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whole, ids and tokens of each piece of A, the same of B); pieces that aren't whole have none."""
        parts, at = [], 0
        while at < len(pieces):
            to, plain = at, self.plain is not None and _PLAIN.fullmatch(pieces[at]) is not None
            while to < len(pieces) and to - at < TOGETHER and (self.plain is not None and _PLAIN.fullmatch(pieces[to]) is not None) == plain:
                to += 1
            some = pieces[at:to]
            if plain and (both := self._joined(some)) is not None:
                parts.append((np.ones(len(some), bool), *both[0], *both[1]))
            else:
                a, b = self.tokens_a(some), self.tokens_b(some)
                whole = self.whole(some, a, b)
                for i in np.flatnonzero(~whole):
                    a[i] = b[i] = []
                n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
                a_id, b_id = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((a, n_a), (b, n_b)))
                parts.append((whole, a_id, n_a, b_id, n_b))
            at = to
        whole, a_id, n_a, b_id, n_b = (np.concatenate(x) for x in zip(*parts, strict=True))
        return whole, a_id, n_a, b_id, n_b

    def align(self, pieces: list[str], named: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of each piece (whole, n_a, n_b, n_groups, n_links); of all its links the piece, pair and number; its groups written out."""
        whole, a_id, n_a, b_id, n_b = self.encoded(pieces)
        a_end, b_end = np.cumsum(self.a_size[a_id]), np.cumsum(self.b_size[b_id])  # both sides have the same bytes, so ends compare over all pieces
        cut = np.intersect1d(a_end, b_end, assume_unique=True)
        a_first, b_first = (np.concatenate([[0], np.searchsorted(e, cut, side="right")]) for e in (a_end, b_end))
        in_a, in_b = np.diff(a_first), np.diff(b_first)
        group_of_a = np.repeat(np.arange(len(cut)), in_a)
        owner = np.repeat(np.arange(len(pieces)), n_a)
        group_owner = owner[a_first[:-1]] if len(cut) else np.zeros(0, np.int64)
        fan = in_b[group_of_a]
        begin = np.cumsum(fan) - fan
        link_b = np.repeat(b_first[:-1][group_of_a] - begin, fan) + np.arange(fan.sum())
        pair = np.repeat(a_id << _LOW, fan) | b_id[link_b]
        link_owner = np.repeat(owner, fan)
        stats = np.stack([whole, n_a, n_b, np.bincount(group_owner, minlength=len(pieces)), np.bincount(link_owner, minlength=len(pieces))], 1).astype(np.int64)
        owner_, pair_, number = _summed(link_owner, pair, np.ones(len(pair), np.int64))
        groups = []
        if named:
            an, bn = [self.a_name[i] for i in a_id.tolist()], [self.b_name[i] for i in b_id.tolist()]
            each = [f"{an[i] if j == i + 1 else ','.join(an[i:j])}|{bn[k] if m == k + 1 else ','.join(bn[k:m])}" for i, j, k, m in zip(a_first[:-1].tolist(), a_first[1:].tolist(), b_first[:-1].tolist(), b_first[1:].tolist(), strict=True)]
            edge = np.concatenate([[0], np.cumsum(stats[:, 3])]).tolist()
            groups = [";".join(each[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
        return stats, owner_, pair_, number, groups


def _summed(owner: np.ndarray, key: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers added up by owner and key, in that order."""
    order = np.lexsort((key, owner))
    owner, key, number = owner[order], key[order], number[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
    return owner[new], key[new], np.add.reduceat(number, new) if len(new) else number


class Remembered:
    """Aligned pieces of a worker, by text, from one task to the next; when they are too many it keeps those met again."""

    _last: tuple[tuple, Remembered] | None = None

    @classmethod
    def of(cls, paths: tuple[str, str], folder: str | None) -> Remembered:
        """Of the counting (no folder of counts), or of the second reading; a worker holds one of them."""
        key = (paths, folder)
        if cls._last is None or cls._last[0] != key:
            cls._last = None
            cls._last = (key, cls(paths, folder is not None, _looked_up(folder) if folder else None))
        return cls._last[1]

    def __init__(self, paths: tuple[str, str], named: bool, extra: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray] | None = None):
        self.aligner, self.named, self.extra = Aligner.of(paths), named, extra
        self.place: dict[str, int] = {}
        self.stats, self.more, self.groups = np.zeros((0, 5), np.int64), np.zeros((0, 2), np.int64), []
        self.pair = self.number = self.uses = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > REMEMBERED // 2:
            keep = keep[:0]
        pieces = list(self.place)
        self.place = {pieces[i]: j for j, i in enumerate(keep.tolist())}
        if self.extra is None:
            size = self.first[keep + 1] - self.first[keep]
            source = np.repeat(self.first[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            self.pair, self.number = self.pair[source], self.number[source]
            self.first = np.concatenate([[0], np.cumsum(size)])
        else:
            self.more = self.more[keep]
        if self.named:
            self.groups = [self.groups[i] for i in keep.tolist()]
        self.stats, self.uses = self.stats[keep], np.zeros(len(keep), np.int64)

    def runs(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, pieces of each text, their places) of runs of texts of about RUN_CHARS."""
        lo = 0
        while lo < len(texts):
            if len(self.place) > REMEMBERED:
                self._forget()
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= RUN_CHARS):
                size += len(texts[hi] or "")
                hi += 1
            split = [PIECES.split(t) if t else [] for t in texts[lo:hi]]
            flat = [p for ps in split for p in ps]
            new = sorted((p for p in dict.fromkeys(flat) if p not in self.place), key=lambda p: _PLAIN.fullmatch(p) is None)
            if new:
                self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
                stats, owner, pair, number, groups = self.aligner.align(new, self.named)
                self.stats = np.concatenate([self.stats, stats])
                self.groups += groups
                if self.extra is not None:
                    self.more = np.concatenate([self.more, self.extra(owner, pair, number, len(new))])
                else:
                    self.pair, self.number = np.concatenate([self.pair, pair]), np.concatenate([self.number, number])
                    self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(owner, minlength=len(new)))])
            at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)]) + np.bincount(at, minlength=len(self.place))
            yield lo, np.fromiter(map(len, split), np.int64, hi - lo), at
            lo = hi


def _alignable(memo: Remembered, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each piece, whether each text is whole on both sides)."""
    row = np.repeat(np.arange(len(n)), n)
    return row, (n > 0) & (np.bincount(row, memo.stats[at, 0] == 0, minlength=len(n)) == 0)


def pair_counts(docs: DataFrame, paths: tuple[str, str], text_col: str = "text") -> DataFrame:
    """(pair, n): in how many documents each linked pair of ids occurs; a pair is the A id times 2**26 plus the B id."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Remembered.of(paths, None)
        pairs, numbers, held = [], [], 0

        def combined() -> pa.RecordBatch:
            _, p, n = _summed(np.zeros(held, np.int8), np.concatenate(pairs), np.concatenate(numbers))
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], ["pair", "n"])

        for b in batches:
            for _, n, at in memo.runs(b.column(0).to_pylist()):
                row, whole = _alignable(memo, n, at)
                keep = whole[row]
                code = np.unique(row[keep] * len(memo.stats) + at[keep])  # each piece once a text
                row, at = code // len(memo.stats), code % len(memo.stats)
                size = memo.first[at + 1] - memo.first[at]
                source = np.repeat(memo.first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                code = np.unique(np.repeat(row, size) << 2 * _LOW | memo.pair[source]) & ((1 << 2 * _LOW) - 1) if len(n) < 1 << 11 else _summed(np.repeat(row, size), memo.pair[source], memo.number[source])[1]
                p, c = np.unique(code, return_counts=True)
                pairs.append(p)
                numbers.append(c)
                held += len(p)
                if held > COMBINE:
                    out = combined()
                    if out.num_rows > COMBINE // 2:
                        yield out
                        pairs, numbers, held = [], [], 0
                    else:
                        pairs, numbers, held = [out.column(0).to_numpy()], [out.column(1).to_numpy()], out.num_rows
        if held:
            yield combined()

    bounded_batches(docs.sparkSession)
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "pair bigint, n bigint")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def store_counts(counts: DataFrame) -> str:
    """Writes the counts as sorted arrays by A id, with a mark on each A id's highest; gives the folder."""
    folder = mounted(new_folder(counts.sparkSession, "pairs"))

    def stored(key: tuple, rows: pa.Table) -> pa.Table:
        pair, n = rows.column("pair").to_numpy(), rows.column("n").to_numpy()
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        a = pair >> _LOW
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(a))))
        shard = key[0].as_py()
        atomic_save(f"{folder}/{shard}-pairs.npy", pair)
        atomic_save(f"{folder}/{shard}-counts.npy", n << 1 | best)
        return pa.table({"shard": pa.array([shard], pa.int32()), "pairs": pa.array([len(pair)], pa.int64())})

    shard = F.shiftright("pair", _LOW) % SHARDS
    counts.withColumn("shard", shard.cast("int")).groupBy("shard").applyInArrow(stored, "shard int, pairs bigint").agg(F.sum("pairs")).first()
    return folder


def _looked_up(folder: str) -> Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]:
    """Sums over each piece's links, of counts and of links whose count is the highest of their A id."""
    opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sums(owner: np.ndarray, pair: np.ndarray, number: np.ndarray, pieces: int) -> np.ndarray:
        keys, back = np.unique(pair, return_inverse=True)
        value = np.zeros(len(keys), np.int64)
        shard = (keys >> _LOW) % SHARDS
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(SHARDS + 1))
        for s in range(SHARDS):
            mine = order[edge[s] : edge[s + 1]]
            if len(mine):
                if s not in opened:
                    opened[s] = tuple(np.load(f"{folder}/{s}-{x}.npy", mmap_mode="r") for x in ("pairs", "counts"))
                value[mine] = opened[s][1][np.searchsorted(opened[s][0], keys[mine])]
        value = value[back]
        out = np.zeros((pieces, 2), np.int64)
        np.add.at(out[:, 0], owner, (value & 1) * number)
        np.add.at(out[:, 1], owner, (value >> 1) * number)
        return out

    return sums


def aligned(docs: DataFrame, folder: str, paths: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", written_out: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (or ``groups`` themselves) of every row."""
    kind, shown = dict(docs.dtypes)[id_col], "groups" if written_out else "groups_sha256"
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Remembered.of(paths, folder)
        for b in batches:
            for lo, n, at in memo.runs(b.column(1).to_pylist()):
                row, whole = _alignable(memo, n, at)
                sums = np.zeros((len(n), 6), np.int64)
                np.add.at(sums, row, np.concatenate([memo.stats[:, 1:], memo.more], 1)[at])
                sums[~whole] = 0
                edge, written, places = np.concatenate([[0], np.cumsum(n)]).tolist(), [], at.tolist()
                for i, ok in enumerate(whole.tolist()):
                    text = ";".join([memo.groups[p] for p in places[edge[i] : edge[i + 1]]]) if ok else ""
                    written.append(text if written_out or not ok else hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(n)), *(pa.array(sums[:, j]) for j in range(6)), pa.array(written, pa.string())], ["doc_id", *names, shown])

    bounded_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(rows, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in names)}, {shown} string")


def tokenizer_paths(at: str = TOKENIZERS) -> tuple[str, str]:
    return f"{at}/{A_FILE}", f"{at}/{B_FILE}"


def align_documents(docs: DataFrame, paths: tuple[str, str] | None = None, written_out: bool = False) -> DataFrame:
    paths = paths or tokenizer_paths()
    return aligned(docs, store_counts(pair_counts(docs, paths)), paths, written_out=written_out)


@dataclass
class Relational:
    """Tokens (uid, side, pos, token, end, grp) of both sides, and links (uid, grp, a, b)."""

    tokens: DataFrame
    links: DataFrame


def relational(docs: DataFrame, paths: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> Relational:
    """The same alignment as a plan of DataFrames, for tables of unique ids and moderate size."""
    kind = dict(docs.dtypes)[id_col]

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = Aligner.of(paths)
        for b in batches:
            texts = b.column(1).to_pylist()
            a, t = al.tokens_a(texts), al.tokens_b(texts)
            for i in np.flatnonzero(~al.whole(texts, a, t)):
                a[i] = t[i] = []
            sizes = ([[len(y[i]) for i in ids] for ids in x] for x, y in ((a, al.a_bytes), (t, al.b_bytes)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in (a, t, *sizes))], ["uid", "a", "b", "a_size", "b_size"])

    rows = docs.select(F.col(id_col).alias("uid"), F.col(text_col).alias("text")).where("text <> ''").mapInArrow(tokenised, f"uid {kind}, a array<int>, b array<int>, a_size array<int>, b_size array<int>")
    by_place = Window.partitionBy("uid").orderBy("pos")

    def side(x: str) -> DataFrame:
        each = rows.select("uid", F.posexplode(F.arrays_zip(F.col(x).alias("token"), F.col(f"{x}_size").alias("size"))).alias("pos", "t"))
        return each.select("uid", "pos", "t.token", F.sum("t.size").over(by_place).alias("end"))

    a, b = side("a"), side("b")
    cuts = a.join(b, ["uid", "end"]).select("uid", "end", F.lit(1).alias("cut"))

    def grouped(x: DataFrame) -> DataFrame:
        before = F.coalesce(F.sum("cut").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return x.join(cuts, ["uid", "end"], "left").withColumn("grp", before).drop("cut")

    a, b = grouped(a), grouped(b)
    links = a.select("uid", "grp", F.col("token").alias("a")).join(b.select("uid", "grp", F.col("token").alias("b")), ["uid", "grp"])
    return Relational(a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b"))), links)
