"""Passages of held-out test items in a corpus, copied or re-parameterised.

Numbers, names and units of a text are replaced by typed placeholders. Windows of the resulting templates are hashed
and joined between items and documents. A window pair is exact if its words agree, and re-parameterised if the words
behind the placeholders differ by a consistent exchange: each value of the item always stands for one and the same
value of the document, over all windows of the pair at one distance.

Placeholders go by shape: a word with a digit, or one of the fixed number words, is a number; the word behind a number
is its unit; a word no item ever writes without a capital is a name or might be one, whoever writes it how. So a
window's template depends on its words alone, whatever their case, equal words have equal templates and no exact passage
is missed. Windows with capitals have a second template, in which every word with a capital is a name, for names that
are plain words elsewhere. A window has twelve words, or as many more as it takes to hold five literals; if its first
twelve hold fewer, they are looked up with the values of their placeholders too, so that copies of them are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.session import cut

_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")

#: Fixed word list: numbers written out.
NUMBER_WORDS = frozenset(
    """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million
null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend
cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil
""".split()
)

#: Least words of a window, and least literals of a template.
WINDOW, LITERALS = 12, 5

_NUMBER, _UNIT, _NAME = (np.uint64(xxhash.xxh64_intdigest("\0" + k)) for k in ("number", "unit", "name"))
_IS_NAME, _IS_LITERAL, _IS_NUMBER = 0, 1, 2
_EXACT = np.uint64(0x5851F42D4C957F2D)

#: Words of a document whose windows are hashed at once.
_CHUNK = 1 << 16

#: Probes and bits a key of the bit table that documents are looked up in, and the most bits it may have: 256 MB.
PROBES, BITS_PER_KEY, MOST_BITS = 4, 16, 1 << 31


def words_of(text: str) -> list[str]:
    """The longest runs of letters and digits of any script, in lower case."""
    return _WORD.findall(text.lower())


def cased_words(text: str) -> tuple[list[str], np.ndarray | None]:
    """(words that give words_of(text) when each is put in lower case, which of them begin with a capital or None if their own letters tell).

    Word by word is the same as the whole text at once, but for two capitals whose lower case depends on what is around them.
    """
    words = _WORD.findall(text)
    if "\u0130" not in text and "\u03a3" not in text:
        return words, None
    lower = words_of(text)
    return lower, np.fromiter((w[0].isupper() for w in words), bool, len(words)) if len(words) == len(lower) else np.zeros(len(lower), bool)


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            base = 0x9E3779B97F4A7C15
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


class Templates:
    """Hashes of words, what stands for them in a template, their kind and whether they have a capital. Holds the words it has seen, up to a bound in characters, for speed only."""

    def __init__(self, literals: np.ndarray, most: int = 5_000_000) -> None:
        self.literals, self.most = literals, most
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.held = 0
        self.exact, self.template, self.kind, self.capital = (np.zeros(1024, t) for t in (np.uint64, np.uint64, np.uint8, bool))

    def _id(self, word: str) -> int:
        i = len(self.ids)
        self.ids[word] = i
        self.held += len(word) + 16
        if i == len(self.exact):
            self.exact, self.template, self.kind, self.capital = (np.concatenate([a, np.zeros_like(a)]) for a in (self.exact, self.template, self.kind, self.capital))
        self.capital[i] = word[0].isupper()
        word = word.lower()
        own = np.uint64(xxhash.xxh64_intdigest(word))
        self.exact[i] = own
        if word in NUMBER_WORDS or _DIGIT.search(word):
            self.template[i], self.kind[i] = _NUMBER, _IS_NUMBER
        else:
            at = int(np.searchsorted(self.literals, own))
            known = at < len(self.literals) and self.literals[at] == own
            self.template[i], self.kind[i] = (own, _IS_LITERAL) if known else (_NAME, _IS_NAME)
        return i

    def hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of the words themselves in lower case, of what stands for them, kinds, capitals)."""
        if self.held > self.most:
            self._reset()
        ids = list(map(self.ids.get, words))
        if None in ids:
            for at, word in enumerate(words):
                if ids[at] is None:
                    known = self.ids.get(word)
                    ids[at] = self._id(word) if known is None else known
        at = np.array(ids, np.int64)
        return self.exact[at], self.template[at], self.kind[at], self.capital[at]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def window_ends(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end of the window that begins at each word, which words are units); an end beyond the text means no window.

    The first word of a window is never a unit, as the word before it is not in the window.
    """
    n = len(kind)
    number = kind == _IS_NUMBER
    unit = np.concatenate([[False], number[:-1]]) & ~number
    literal = (kind == _IS_LITERAL) & ~unit
    places = np.append(np.flatnonzero(literal), n)
    last = np.cumsum(literal) + LITERALS - 1 - (kind == _IS_LITERAL)
    end = np.maximum(np.arange(n) + WINDOW, places[np.minimum(last, len(places) - 1)] + 1)
    return end, unit


def text_keys(exact: np.ndarray, template: np.ndarray, kind: np.ndarray, capital: np.ndarray, longest: int, powers: Powers) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, keys) of all windows of a text of at most ``longest`` words."""
    capital = capital & (kind == _IS_LITERAL)
    for at in range(0, max(0, len(exact) - WINDOW + 1), _CHUNK):
        part = slice(at, at + _CHUNK + longest)
        up, down = powers.get(len(exact[part]) + 1)
        forms = [(template[part], kind[part], None)]
        if capital[part].any():
            c = capital[part]
            forms.append((np.where(c, _NAME, template[part]), np.where(c, np.uint8(_IS_NAME), kind[part]), np.concatenate([[0], np.cumsum(c)])))
        with np.errstate(over="ignore"):
            for t, k, changed in forms:
                n = len(t)
                end, unit = window_ends(k)
                here = np.where(unit, _UNIT, t)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(here * up[:n], dtype=np.uint64)])
                start = np.flatnonzero((end <= n) & (end - np.arange(n) <= longest))
                start = start[start < _CHUNK]
                if changed is not None:
                    start = start[changed[end[start]] > changed[start]]
                stop = end[start]
                key = (sums[stop] - sums[start]) * down[start] - here[start] + t[start]
                yield start + at, stop + at, _mixed(key + (stop - start).astype(np.uint64))
                if changed is None:
                    start = np.flatnonzero(end[: max(0, n - WINDOW + 1)] != np.arange(max(0, n - WINDOW + 1)) + WINDOW)
                    start = start[start < _CHUNK]
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(exact[part] * up[:n], dtype=np.uint64)])
                    yield start + at, start + at + WINDOW, _mixed(((sums[start + WINDOW] - sums[start]) * down[start]) ^ _EXACT)


def _bits(keys: np.ndarray, n_bits: int) -> list[np.ndarray]:
    """The bits of each key in a table of n_bits, a power of two."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((keys + step * np.uint64(j)) & np.uint64(n_bits - 1)).astype(np.int64) for j in range(PROBES)]


def key_table(keys: DataFrame, n: int) -> np.ndarray:
    """Bit table of n distinct keys, built in chunks by the executors. Keys beyond its greatest size only make it spare less."""
    n_bits = min(MOST_BITS, 1 << max(19, int(n * BITS_PER_KEY).bit_length()))
    chunk = 19

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.unique(np.concatenate(_bits(pdf["key"].to_numpy(np.int64).view(np.uint64), n_bits)))
            yield pd.DataFrame({"chunk": (at >> chunk).astype(np.int32), "at": at & ((1 << chunk) - 1)})

    def filled(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << chunk, np.uint8)
        bits[pdf["at"].to_numpy()] = 1
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    table = np.zeros(n_bits >> 3, np.uint8)
    size = 1 << (chunk - 3)
    for r in keys.mapInPandas(places, "chunk int, at long").distinct().groupBy("chunk").applyInPandas(filled, "chunk int, bits binary").collect():
        table[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table


def table_hits(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys that may be in the table: all that are, and few others."""
    at = np.arange(len(keys))
    step = (keys >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64(len(table) * 8 - 1)
    for j in range(PROBES):
        with np.errstate(over="ignore"):
            bit = ((keys[at] + step[at] * np.uint64(j)) & mask).astype(np.int64)
        at = at[(table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
        if not len(at):
            break
    return at


def literal_words(items: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that items write without a capital; 8 bytes for each word of the items' vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = {w.lower() for t in pdf["text"] if t for w in set(_WORD.findall(t)) if not w[0].isupper()}
            yield pd.DataFrame({"word": np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)})

    found = items.select("text").mapInPandas(run, "word long").distinct().toPandas()["word"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


_WINDOWS = "id long, pos int, n int, key long, words string"


def text_windows(texts: DataFrame, literals: Broadcast, longest: int | None = None, table: Broadcast | None = None) -> DataFrame:
    """(id, pos, n, key, words) of the windows of (id, text) rows; with a table only those that may be in it.

    Null ids and texts have no windows. Every window of a whole text is looked up, but for those longer than ``longest``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates, powers = Templates(literals.value), Powers()
        for pdf in batches:
            ids, at, size, keys, said = [], [], [], [], []
            for i, text in zip(pdf["id"], pdf["text"]):
                if text is None or pd.isna(i):
                    continue
                words, capital = cased_words(text)
                if len(words) < WINDOW:
                    continue
                exact, template, kind, own = templates.hashes(words)
                for starts, ends, key in text_keys(exact, template, kind, own if capital is None else capital, longest or len(words), powers):
                    if table is not None:
                        hit = table_hits(table.value, key)
                        starts, ends, key = starts[hit], ends[hit], key[hit]
                    for a, b in zip(starts.tolist(), ends.tolist()):
                        ids.append(i)
                        at.append(a)
                        size.append(b - a)
                        said.append(" ".join([w.lower() for w in words[a:b]]))
                    keys.append(key)
            if ids:
                yield pd.DataFrame({"id": ids, "pos": at, "n": size, "key": np.concatenate(keys).view(np.int64), "words": said})

    return texts.mapInPandas(run, _WINDOWS)


def leaks(documents: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", rows_per_salt: int = 20_000) -> DataFrame:
    """(doc_id, item_id, exact_windows, template_windows, kind): documents that hold a passage of at least 12 words.

    kind is exact if any window of 12 words agrees word by word, else template; of template windows only those count whose
    placeholders are exchanged consistently. A passage with fewer than five literals in all has no template and is found
    as an exact one only. Items and documents with fewer than 12 words, empty or null, hold no passage; a repeated id is
    taken as one text after the other. The documents are read once, whatever the number of items: a bit table of the
    items' keys spares nearly all of their windows, and the join by key decides on the others.
    """
    sc = documents.sparkSession.sparkContext
    bench = items.select(F.col(item_key).cast("long").alias("id"), F.col(text).alias("text"))
    literals = sc.broadcast(literal_words(bench))
    windows = cut(text_windows(bench, literals).distinct())
    longest = windows.agg(F.max("n")).first()[0]
    if longest is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, exact_windows long, template_windows long, kind string")
    keys = windows.select("key").distinct()
    table = sc.broadcast(key_table(keys, keys.count()))
    docs = documents.select(F.col(doc_key).cast("long").alias("id"), F.col(text).alias("text"))
    found = cut(text_windows(docs, literals, longest, table))
    table.unpersist()
    # a window that many documents share, or one document many times, is spread over salts, and the items' windows of that key go to each
    hot = found.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > rows_per_salt).select("key", F.ceil(F.col("c") / rows_per_salt).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    left = found.join(hot, "key", "left").select(F.col("id").alias("doc_id"), "pos", "key", F.col("words").alias("said"), F.pmod(F.xxhash64("id", "pos"), salts).cast("int").alias("salt"))
    right = windows.join(hot, "key", "left").select(F.col("id").alias("item_id"), F.col("pos").alias("ipos"), "n", "key", "words", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    both = left.join(right, ["key", "salt"]).withColumn("exact", F.col("said") == F.col("words"))
    # equal words in a longer window are in the windows of twelve too
    return _judge(both.where(~F.col("exact") | (F.col("n") == WINDOW)))


def _judge(both: DataFrame) -> DataFrame:
    """Slot consistency per (document, item, distance), then one row per document and item."""
    a, b = F.split("words", " "), F.split("said", " ")
    # words that stay the same count too: a value may not be kept in one place and exchanged in another
    kept = F.when(~F.col("exact"), F.zip_with(a, b, lambda x, y: F.struct(x.alias("i"), y.alias("d"))))
    shift = (F.col("pos") - F.col("ipos")).alias("shift")
    # a window may agree in both of its templates
    once = both.groupBy("doc_id", "item_id", shift, "pos").agg(F.max("exact").alias("exact"), F.array_distinct(F.flatten(F.collect_set(kept))).alias("pairs"))
    per = once.groupBy("doc_id", "item_id", "shift").agg(F.sum(F.col("exact").cast("long")).alias("exact_windows"), F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    one_way = lambda f: F.size(F.array_distinct(F.transform("pairs", lambda s: s[f]))) == F.size("pairs")
    per = per.withColumn("template", F.when(one_way("i") & one_way("d"), F.col("n") - F.col("exact_windows")).otherwise(0))
    out = per.groupBy("doc_id", "item_id").agg(F.sum("exact_windows").alias("exact_windows"), F.sum("template").alias("template_windows"))
    out = out.where((F.col("exact_windows") > 0) | (F.col("template_windows") > 0))
    return out.withColumn("kind", F.when(F.col("exact_windows") > 0, "exact").otherwise("template"))
