"""What declarations teach: brands, phrases, headings and candidates for a taxonomy."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from customsloom.functions.numbers import round_up
from customsloom.functions.text import fold, search_tokens, words_of


def brand_map(rows: DataFrame, brands: DataFrame, text_col: str = "description") -> DataFrame:
    """Weight of each (brand, cn8): a brand's words meet a text's by an equi-join, whole words only, once a text."""
    words = rows.select("id", "cn8", "weight", F.explode(F.array_distinct(search_tokens(F.col(text_col), 1))).alias("brand"))
    return words.join(brands.select("brand").distinct(), "brand").groupBy("brand", "cn8").agg(round_up(F.sum("weight"), 2).alias("frequency"))


#: Beginnings of phrases that a task counts at a time, as a power of two.
SLOTS = 20
#: Bytes of words that a task takes at a time, if codes are that short; and of a code from which on its phrases are dealt out to several tasks.
CHUNK, MOST_TEXT = 1 << 23, 1 << 25
Batches = Iterator[pa.RecordBatch]


def _phrases(rows: DataFrame, sizes: tuple[int, int], gain: Column, least: float) -> DataFrame:
    """(phrase, cn8, texts, and the other columns' sums) of the phrases that gain at least ``least`` in the texts of their code.

    Rows are (cn8, words, figures, and perhaps ``text``, which tells texts apart, and ``bytes``, their length); each text counts once a phrase.  The texts are
    shuffled and their phrases aren't: those of a code meet in a task, or if they are long in several, each with the phrases of other first words.
    """
    figures = [c for c in rows.columns if c not in ("cn8", "words", "text", "bytes")]
    text, size = F.col("text") if "text" in rows.columns else F.xxhash64("words"), F.col("bytes") if "bytes" in rows.columns else F.octet_length(F.array_join("words", " "))
    long = rows.groupBy("cn8").agg(F.sum(size).alias("_bytes")).where(F.col("_bytes") > MOST_TEXT).select(F.col("cn8").alias("_code"), F.ceil(F.col("_bytes") * sizes[1] / MOST_TEXT).cast("int").alias("_parts"))
    rows = rows.select("cn8", F.lit(None).cast("int").alias("part"), text.alias("text"), F.array_join("words", " ").alias("words"), F.greatest(gain, F.lit(0.0)).alias("_gain"), *figures)
    if not long.isEmpty():
        own = F.col("cn8").eqNullSafe(F.col("_code"))
        dealt = rows.join(F.broadcast(long), own).drop("part", "_code").mapInArrow(_dealer(sizes), rows.select(*(c for c in rows.columns if c != "part"), "part").schema)  # at most a row of ``long`` for MOST_TEXT of input
        rows = rows.join(F.broadcast(long), own, "left_anti").unionByName(dealt)
    kinds = dict(rows.dtypes)
    sums = {c: "double" if kinds[c] in ("float", "double") else "bigint" for c in figures}
    schema = ", ".join(["phrase string", f"cn8 {kinds['cn8']}", "texts bigint", *(f"`{c}` {k}" for c, k in sums.items())])
    return rows.repartition("cn8", "part").sortWithinPartitions("cn8", "part", "text").mapInArrow(_counter(sizes, sums, least, 1 << SLOTS), schema)


def _dealer(sizes: tuple[int, int]) -> Callable[[Batches], Batches]:
    """A text as rows of the distinct phrases of most words that begin in it, a line each, by number of their first words."""

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            words, parts = batch.column("words"), batch.column("_parts").to_pylist()
            row, part, lines, size = [], [], [], 0

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                out = batch.take(pa.array(row)).drop_columns(["_parts"])  # noqa: B023
                return out.set_column(out.schema.get_field_index("words"), "words", pa.array(lines, pa.string())).append_column("part", pa.array(part, pa.int32()))  # noqa: B023

            for i, n in enumerate(parts):
                each = words[i].as_py().split(" ")
                by = defaultdict(list)
                for phrase in dict.fromkeys(tuple(each[j : j + sizes[1]]) for j in range(len(each) - sizes[0] + 1)):
                    by[zlib.crc32(" ".join(phrase[: sizes[0]]).encode()) % n].append(" ".join(phrase))
                for p, found in by.items():
                    row.append(i)
                    part.append(p)
                    lines.append("\n".join(found))
                    size += len(lines[-1])
                if size > CHUNK:
                    yield made()
                    row, part, lines, size = [], [], [], 0
            if row:
                yield made()

    return deal


def _counter(sizes: tuple[int, int], sums: dict[str, str], least: float, at_once: int) -> Callable[[Batches], Batches]:
    """Phrases with their sums of rows that are sorted by code, part and text; several short codes are counted together, a long one by itself."""

    def counted(held: list[pa.RecordBatch]) -> Batches:
        rows = pa.Table.from_batches(held).combine_chunks()
        if rows.num_rows:
            yield from _of_codes(rows, sizes, sums, least, at_once)

    def count(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            begins, own = _changes(batch, "cn8", "part"), (batch.column("cn8")[0].as_py(), batch.column("part")[0].as_py())
            begins[0] = own != last
            last = (batch.column("cn8")[-1].as_py(), batch.column("part")[-1].as_py())
            at, ends = 0, np.cumsum(pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64))
            for i in np.flatnonzero(begins).tolist():
                here = int(ends[i - 1]) if i else 0
                if size + here - (int(ends[at - 1]) if at else 0) >= CHUNK:
                    yield from counted([*held, batch.slice(at, i - at)])
                    held, size, at = [], 0, i
            held.append(batch.slice(at))
            size += int(ends[-1]) - (int(ends[at - 1]) if at else 0)
        if held:
            yield from counted(held)

    return count


def _changes(rows: pa.RecordBatch | pa.Table, *columns: str) -> np.ndarray:
    """Where a row differs from the one before; true for the first."""
    out = np.zeros(rows.num_rows, bool)
    out[0] = True
    for c in columns:
        column = rows.column(c)
        coded = pc.dictionary_encode(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, null_encoding="encode")
        number = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).indices.to_numpy()
        out[1:] |= number[1:] != number[:-1]
    return out


def _of_codes(rows: pa.Table, sizes: tuple[int, int], sums: dict[str, str], least: float, at_once: int) -> Batches:
    """The phrases of whole codes, or of their parts; only those whose beginnings gain enough grow by a word.  About ``at_once`` of them are counted at a time, dealt by their first words."""
    code = np.cumsum(_changes(rows, "cn8", "part")) - 1
    first = np.flatnonzero(_changes(rows, "cn8", "part", "text"))  # equal texts of a code are one, with all their figures
    added = {c: np.add.reduceat(rows.column(c).to_numpy(), first) for c in ["_gain", *sums]}
    codes, texts, code, dealt = rows.column("cn8").take(first), rows.column("words").take(first).combine_chunks(), code[first], rows.column("part").is_valid().to_numpy()[first]
    names, word, text, before = words_of(texts, np.arange(256) > 32)
    if not len(word):
        return
    chars, fresh = pc.binary_length(names).to_numpy(), np.ones(len(word), bool)
    fresh[1:] = text[1:] != text[:-1]
    line = dealt[text] & (before == 10) | fresh
    run = np.cumsum(line, dtype=np.int32)
    starts = np.flatnonzero(line | ~dealt[text]).astype(np.int32)
    blocks = -(-len(starts) // at_once)
    if blocks > 1:
        mixed = code[text[starts]].astype(np.uint64)
        for j in range(sizes[0]):
            mixed = (mixed ^ word[np.minimum(starts + j, len(word) - 1)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        block = (mixed % np.uint64(blocks)).astype(np.int32)
    for b in range(blocks):
        place, most = starts[block == b] if blocks > 1 else starts, int(code[-1]) + 1
        phrase = code[text[place]].astype(np.int64)
        for n in range(1, sizes[1] + 1):
            inside = np.minimum(place + n - 1, len(word) - 1)
            inside = (run[inside] == run[place]) & (place + n - 1 < len(word))
            place, phrase = place[inside], phrase[inside]
            if not len(place):
                break
            key, most = phrase * len(names) + word[place + n - 1], most * len(names)
            if n < sizes[0] and most * len(names) < 1 << 62:
                phrase = key
                continue
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            phrase, held = np.cumsum(new) - 1, text[place]
            most = int(phrase[-1]) + 1
            once = new.copy()
            once[1:] |= held[1:] != held[:-1]
            number, held, example = phrase[once], held[once], place[new]
            good = ~(np.bincount(number, added["_gain"][held], most) < least)
            if n >= sizes[0]:
                shown = np.flatnonzero(good & (sum(chars[word[example + j]] for j in range(n)) + n - 1 >= 6))
                example = example[shown]
                of = lambda w: np.bincount(number, w, most)[shown]  # noqa: B023, E731
                columns = [pc.binary_join_element_wise(*(names.take(pa.array(word[example + j])) for j in range(n)), " "), codes.take(pa.array(text[example])).combine_chunks(), pa.array(of(None))]
                columns += [pa.array(of(added[c][held]).astype(np.float64 if k == "double" else np.int64)) for c, k in sums.items()]
                if len(shown):
                    yield pa.RecordBatch.from_arrays(columns, ["phrase", "cn8", "texts", *sums])
            more = good[phrase]
            place, phrase = place[more], phrase[more]


def phrase_lexicon(rows: DataFrame, text_col: str = "description", least: float = 5.0, sizes: tuple[int, int] = (2, 4)) -> DataFrame:
    """Phrases of neighbouring tokens with the weight of the texts that hold them, by code, from ``least`` on."""
    words = rows.where("weight IS NOT NULL").select("cn8", "weight", F.octet_length(text_col).alias("bytes"), search_tokens(fold(F.col(text_col)), 2).alias("words"))
    phrases = _phrases(words, sizes, F.col("weight"), least - 0.01)  # sums are rounded
    return phrases.select("phrase", "cn8", round_up(F.col("weight"), 2).alias("weight")).where(F.col("weight") >= least)


def heading_profiles(rows: DataFrame, text_col: str = "description", codes: int = 8, phrases: int = 12) -> DataFrame:
    """Per heading its weight, its best codes and its commonest first four words."""

    def top(counts: DataFrame, item: str, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("heading").orderBy(F.desc("w"), item))
        kept = counts.withColumn("_r", rank).where(F.col("_r") <= k)
        return kept.groupBy("heading").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", item))), lambda x: x[item]), "|").alias(f"top_{item}"))

    words = search_tokens(fold(F.col(text_col)), 3)
    own = rows.select("heading", "cn8", "weight", F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 4), " ")).alias("phrase"))
    weight = own.groupBy("heading").agg(round_up(F.sum("weight"), 2).alias("weight"))
    best = top(own.groupBy("heading", "cn8").agg(round_up(F.sum("weight"), 2).alias("w")), "cn8", codes)
    common = top(own.where("phrase IS NOT NULL").groupBy("heading", "phrase").agg(round_up(F.sum("weight"), 2).alias("w")), "phrase", phrases)
    return weight.join(best, "heading", "left").join(common, "heading", "left")


def phrase_stats(rows: DataFrame, text_col: str = "description", sizes: tuple[int, int] = (2, 3), least: int = 1) -> DataFrame:
    """Per (phrase, cn8) in at least ``least`` texts: texts that hold it, distinct ones, and those of the seed beside the others."""
    hits = lambda mine: F.when(mine, 1).otherwise(0)
    words = rows.select(
        "cn8", F.xxhash64(text_col).alias("text"), F.octet_length(text_col).alias("bytes"), search_tokens(fold(F.col(text_col)), 2).alias("words"),
        F.lit(1).alias("frequency"), hits(F.col("source") == "seed").alias("seed_hits"), hits(F.col("source") != "seed").alias("other_hits"),
    )
    return _phrases(words, sizes, F.lit(1.0), least).select("phrase", "cn8", "frequency", F.col("texts").alias("unique_descriptions"), "seed_hits", "other_hits")


def without_covered(phrases: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Phrases that no phrase of the taxonomy equals, holds or is held by: whole words, found by the words of each phrase."""
    words = taxonomy.select(F.col("phrase").alias("known")).distinct()
    near = phrases.select("phrase").distinct().withColumn("word", F.explode(F.split("phrase", " "))).join(words.withColumn("word", F.explode(F.split("known", " "))), "word")
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    covered = near.where(pad("phrase").contains(pad("known")) | pad("known").contains(pad("phrase"))).select("phrase").distinct()
    return phrases.join(covered, "phrase", "left_anti")


def maximal_phrases(phrases: DataFrame) -> DataFrame:
    """Phrases without those that a longer one of the same code and at least their score holds."""
    words = phrases.select("cn8", "phrase", "score", F.explode(F.split("phrase", " ")).alias("word"))
    a, b = words.alias("a"), words.alias("b")
    inner = a.join(b, (F.col("a.cn8") == F.col("b.cn8")) & (F.col("a.word") == F.col("b.word")) & (F.length("a.phrase") < F.length("b.phrase")) & (F.col("b.score") >= F.col("a.score")))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    held = inner.where(pad("b.phrase").contains(pad("a.phrase"))).select(F.col("a.cn8").alias("cn8"), F.col("a.phrase").alias("phrase")).distinct()
    return phrases.join(held, ["cn8", "phrase"], "left_anti")


#: Words that don't tell, words of trade at large, and pieces of codes of materials.  The lists are the caller's; these are small defaults.
STOPWORDS = ("and", "for", "of", "the", "with", "in", "za", "in", "ali", "na", "pcs", "kos")
MATERIAL = r"^(?:aisi)?\d{3}l?$|^[a-z]{1,3}\d{2,4}$"


def phrase_verdict(phrase: Column, frequency: Column, seed_only: Column, covered: Column, markers: list[str], generic: list[str], least: int = 5, stopwords: tuple[str, ...] = STOPWORDS, material: str = MATERIAL) -> Column:
    """Why a phrase is no candidate of the first tier, the first reason that holds; null if none does.

    below_min_frequency; phrase_quality (2 to 6 words, no number first, at least two that mean something, less than half of these generic, three of them or a marker); not_industrial (no marker);
    numeric_fragment (pieces or counts, a short first word, a pair of words that aren't both markers, numbers among fewer than four words); regression_only_frequency; taxonomy_covered.
    """
    named = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    words = F.filter(F.split(F.lower(phrase), r"[^a-z0-9]+"), lambda x: x != "")
    is_material = lambda x: x.rlike(material)
    meaning = F.filter(words, lambda x: ~F.array_contains(named(stopwords), x) & ~x.rlike(r"^\d+$") & (is_material(x) | (F.length(x) >= 2)))
    marked = F.exists(words, lambda x: F.array_contains(named(markers), x) | is_material(x))
    n, first = F.size(meaning), F.get(words, F.lit(0))
    generic_share = F.size(F.filter(meaning, lambda x: F.array_contains(named(generic), x))) / F.greatest(n, F.lit(1))
    good = F.size(words).between(2, 6) & ~first.rlike(r"^\d+$") & (n >= 2) & (generic_share < 0.5) & ((n >= 3) | marked)
    noise = F.exists(words, lambda x: x.rlike(r"^\d+[a-z]{0,2}$"))
    pair = (F.size(words) != 2) | F.forall(words, lambda x: F.array_contains(named(markers), x))
    tier = ~F.arrays_overlap(words, named(("pcs", "kos"))) & ((F.length(first) > 2) | is_material(first)) & pair & (~noise | (n >= 4))
    return (
        F.when(frequency < least, "below_min_frequency").when(~good, "phrase_quality").when(~marked, "not_industrial").when(~tier, "numeric_fragment")
        .when(seed_only, "regression_only_frequency").when(covered, "taxonomy_covered")
    )


def tier_candidates(stats: DataFrame, verdict: Column, impact: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates, reasons) of phrase statistics (phrase, cn8, frequency, unique_descriptions, ...): those without a verdict, scored by frequency, uniqueness and impact; and how many each reason rejects."""
    judged = stats.withColumn("reason", verdict)
    score = round_up(F.col("unique_descriptions") * (1.0 + impact), 4)
    kept = judged.where("reason IS NULL").withColumns({"uniqueness": round_up(F.col("unique_descriptions") / F.col("frequency"), 4), "score": score, "heading": F.substring("cn8", 1, 4)}).drop("reason")
    return maximal_phrases(kept.select("cn8", "phrase", "score")).join(kept.drop("score"), ["cn8", "phrase"]), judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("phrases"))
