"""Encoding of texts with a public byte-level BPE vocabulary, folded by higher-order functions."""

from __future__ import annotations

import base64
import heapq
import importlib
import json
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All Unicode white space, as a class of its own is matched faster than \s under (?U).
_S = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The words of the vocabulary's scheme.
WORDS = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Longer words get the same ids from an O(n log n) merge, as the fold is quadratic in a word.
LONG = 120
#: At most so many words of so many bytes are held as a literal dictionary: a few MB whatever the corpus.
KEPT_WORDS, KEPT_BYTES = 16_384, 48
_SHIFT = 1 << 16
#: Stands for all groups that have no name of their own.
OTHER = "\x00other"


def default_vocabulary() -> str:
    """Path of byte_bpe_50k.tiktoken among the installed public tokenizer files."""
    try:
        return importlib.import_module("public_tokenizers").path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _slow_bpe(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)))
        if best[0] >= below:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, and merges as (left id, right id) -> merged id; a smaller merged id merges first."""

    pieces: tuple[bytes, ...]
    merges: dict[tuple[int, int], int]

    @property
    def byte_ids(self) -> list[int]:
        at = {p: i for i, p in enumerate(self.pieces) if len(p) == 1}
        return [at[bytes([b])] for b in range(256)]


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The vocabulary file: base64 piece and rank a line. Each longer piece is split into the two parts
    that the merges before it make of it."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
    merges = {}
    for piece, rank in ranks.items():
        pieces[rank] = piece
        if len(piece) > 1:
            two = _slow_bpe(piece, ranks, rank)
            if len(two) == 2:
                merges[ranks[two[0]], ranks[two[1]]] = rank
    return Vocabulary(tuple(pieces), merges)


def _placed(keys: list[int], buckets: int = 16_381, slots: int = 65_536) -> tuple[int, list[int], list[int]]:
    """(modulus, displacement, slot table): every key k has slot (k % modulus + displacement[k % buckets]) % slots alone."""
    for modulus in range(1_000_003, 1_001_003, 10):
        groups: list[list[int]] = [[] for _ in range(buckets)]
        for k in keys:
            groups[k % buckets].append(k)
        shift, table, done = [0] * buckets, [-1] * slots, True
        for b in sorted(range(buckets), key=lambda b: -len(groups[b])):
            at = [k % modulus for k in groups[b]]
            if len({a % slots for a in at}) < len(at):
                done = False
                break
            d = next((d for d in range(slots) if all(table[(a + d) % slots] < 0 for a in at)), None)
            if d is None:
                done = False
                break
            shift[b] = d
            for k, a in zip(groups[b], at, strict=True):
                table[(a + d) % slots] = k
        if done:
            return modulus, shift, table
    raise ValueError("no placement without clash")


def _literal(values: list, kind: str) -> Column:
    """A large literal: parsed once, as the optimiser folds it."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)


@lru_cache(maxsize=4)
def _placed_merges(path: str) -> tuple[int, list[int], list[int]]:
    """As ``_placed``; a slot holds key x 2**16 + merged id, -1 if it is free."""
    merges = {a * _SHIFT + b: c for (a, b), c in load(path).merges.items()}
    modulus, shift, table = _placed(list(merges))
    return modulus, shift, [k * _SHIFT + merges[k] if k >= 0 else -1 for k in table]


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_word(word: Column, path: str) -> Column:
    """Token ids of one word: its bytes, then merge after merge, the smallest merged id first.

    The rank map is a literal of two arrays without clashes: one look-up is two array reads.
    """
    modulus, shift, table = _placed_merges(path)
    shift_l, table_l = _literal(shift, "array<int>"), _literal(table, "array<bigint>")
    bytes_l = _literal(load(path).byte_ids, "array<int>")
    # the entry of a key is the key and the merged id, so what differs from the key alone is the id, or large
    place = lambda k: ((k % modulus + F.get(shift_l, (k % 16_381).cast("int"))) % 65_536).cast("int")
    rank = lambda k: F.get(table_l, place(k)).bitwiseXOR(F.shiftleft(k, 16)).bitwiseAND(F.lit((1 << 63) - 1))

    def step(ids: Column, _: Column) -> Column:
        n = F.size(ids)
        keys = F.zip_with(F.slice(ids, F.lit(1), n - 1), F.slice(ids, F.lit(2), n - 1), lambda a, b: a.cast("bigint") * _SHIFT + b)
        merged = lambda rs, best: _let(F.array_position(rs, best).cast("int"), lambda j: F.concat(F.slice(ids, F.lit(1), j - 1), F.array(best.cast("int")), F.slice(ids, j + 2, n)))
        return F.when(n < 2, ids).otherwise(_let(F.transform(keys, rank), lambda rs: _let(F.array_min(rs), lambda best: F.when(best < _SHIFT, merged(rs, best)).otherwise(ids))))

    of_bytes = lambda raw: F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.get(bytes_l, F.ascii(F.substring(raw, i, F.lit(1)))))
    first = _let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), of_bytes)
    return F.aggregate(F.sequence(F.lit(2), F.greatest(F.octet_length(word), F.lit(2))), first, step)


def words_of(text: str | Column) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(WORDS), F.lit(0))


def heap_encode(word: bytes, merges: dict[tuple[int, int], int], byte_ids: list[int]) -> list[int]:
    """Token ids of one long word in O(n log n)."""
    ids = [byte_ids[b] for b in word]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        m, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = m, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (x := merges.get((m, ids[after[i]]))) is not None:
                heapq.heappush(heap, (x, i, m, ids[after[i]]))
        if before[i] >= 0 and (x := merges.get((ids[before[i]], m))) is not None:
            heapq.heappush(heap, (x, before[i], ids[before[i]], m))
    return [x for x in ids if x >= 0]


def _long_encoder(path: str):
    """Ids of the words of an array; null for a null word and a null array."""
    @F.pandas_udf("array<array<int>>")
    def encode(words: pd.Series) -> pd.Series:
        one = lambda w: None if w is None else heap_encode(w.encode(), load(path).merges, load(path).byte_ids)
        return words.map(lambda ws: None if ws is None else [one(w) for w in ws])

    return encode


def _word_encoder(docs: DataFrame, path: str) -> Column | None:
    """Look-up of the most frequent words of ``docs``: counted over all documents, folded once each."""
    counted = docs.select(F.explode(words_of("_text")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    top = counted.where(F.octet_length("w") <= KEPT_BYTES).orderBy(F.desc("n"), "w").limit(KEPT_WORDS)
    slots = 2 * KEPT_WORDS
    # KEPT_WORDS rows of KEPT_BYTES bytes at most
    rows = top.select("w", F.pmod(F.xxhash64("w"), F.lit(slots)).cast("int").alias("slot"), fold_word(F.col("w"), path).alias("ids")).collect()
    if not rows:
        return None
    table: list[dict[str, list[int]]] = [{} for _ in range(slots)]
    for r in rows:
        table[r["slot"]][r["w"]] = r["ids"]
    return _literal(table, "array<map<string,array<int>>>")


def encode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_column, ids) and the columns to ``keep``: the token ids of every text; an empty list for null and for empty texts.

    Frequent words are looked up in a literal dictionary of bounded size, others are folded where they
    stand, so the texts never cross an exchange; most of these stand once in a corpus, so that to fold every distinct word
    once and join it back would be as many folds and an exchange of all texts. Only words of more than LONG characters
    leave the fold: they get the same merges from a heap in Python, the rest of their text does not. Ids repeat with their rows.
    """
    path = path or default_vocabulary()
    carried = [id_column, *keep]
    named = docs.select(*carried, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    table = _word_encoder(named, path)
    words = named.select(*carried, words_of("_text").alias("_words"))
    is_long = lambda w: F.length(w) > LONG

    def one(w: Column) -> Column:
        if table is None:
            return fold_word(w, path)
        return F.coalesce(F.try_element_at(F.get(table, F.pmod(F.xxhash64(w), F.lit(2 * KEPT_WORDS)).cast("int")), w), fold_word(w, path))

    lengthy = F.when(F.exists("_words", is_long), F.transform("_words", lambda w: F.when(is_long(w), w)))
    words = words.withColumn("_long", _long_encoder(path)(lengthy))
    ids = F.transform("_words", lambda w, i: F.coalesce(F.get("_long", i), one(w)))
    return words.select(*carried, F.flatten(ids).alias("ids"))


def decode(encoded: DataFrame, path: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """(id_column, text): the binary pieces of the ids, joined and read as UTF-8."""
    pieces = _literal([p.hex() for p in load(path or default_vocabulary()).pieces], "array<string>")
    joined = F.unhex(F.array_join(F.transform("ids", lambda i: F.get(pieces, i)), ""))
    return encoded.select(id_column, F.decode(joined, "UTF-8").alias("text"))


def token_totals(docs: DataFrame, group: str, path: str | None = None, only: list[str] | None = None) -> DataFrame:
    """(group, tokens): tokens of all texts of each group, null groups left out; groups that are not among
    ``only``, if that is given, are added up under the name OTHER.

    Words are counted per group before anything else, and every distinct word is folded once. A word keeps a
    count per group, so ``only`` also bounds what a word carries where groups are many.
    """
    path = path or default_vocabulary()
    g = F.col(group) if only is None else F.when(F.col(group).isin(only), F.col(group)).otherwise(OTHER)
    named = docs.where(F.col(group).isNotNull()).select(g.alias("g"), F.coalesce("text", F.lit("")).alias("text"))
    counted = named.select("g", F.explode(words_of("text")).alias("w")).groupBy("w", "g").agg(F.count("*").alias("n"))
    word = counted.groupBy("w").agg(F.collect_list(F.struct("g", "n")).alias("by"))
    usual = word.where(F.length("w") <= LONG).select("by", F.size(fold_word(F.col("w"), path)).alias("k"))
    rest = word.where(F.length("w") > LONG).select("by", F.size(F.get(_long_encoder(path)(F.array("w")), F.lit(0))).alias("k"))
    return usual.union(rest).select("k", F.inline("by")).groupBy(F.col("g").alias(group)).agg(F.sum(F.col("n") * F.col("k")).alias("tokens"))
