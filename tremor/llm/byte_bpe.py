"""Byte-level BPE by higher-order functions (operator 13): ranked merges folded over the bytes of words.

A word (a match of the splitting pattern) becomes a string with one character a byte, then one character a
token: the character whose code is the token's id. All substrings of its bytes are looked up in a rank map by
their checksums; what is found, in order of rank, has all merges that can happen in this word, and ``aggregate``
folds them over a few words at a time, each a ``replace`` of a pair of tokens by the merged one. As every merged token is made of
one pair of lower ranks (``RankMap`` refuses files where that is not so), applying merges in order of rank gives
what the library gets by always merging the pair of least rank; a merge found by a checksum that other bytes share
is one of the file too, so it does no harm. A word costs (bytes x longest token) lookups at most and
one pass over it a merge, so very long words are not quadratic in lookups.

Words are counted over all texts; those frequent enough to be among the ``DICTIONARY`` most frequent are encoded
once and sent to the tasks too, which is bounded by that parameter. All other words are folded
where they stand, so the dictionary changes the cost only, never the result. Texts are not shuffled.

Rank map and dictionary reach the tasks as the one row of a scalar subquery, not as literals: Spark keeps the text
of each plan on the driver, and theirs would be tens of MB.

Decoding looks up the bytes of every id and concatenates them.

Edge cases: null and empty texts have no tokens and decode to nothing; rows that repeat a doc_id are encoded row
by row; a null doc_id stays null; an empty table gives no rows; extra columns are ignored. Code points that newer
versions of Unicode than the JVM's made letters or digits count as symbols here.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.workspace import documents, stored

VOCABULARY, DICTIONARY, SLOTS, STARTS, BATCH = "byte_bpe_multi_50k.tiktoken", 1 << 18, 1 << 20, 1 << 18, 8
#: Characters that are no byte and no token: between slots or words, the token of id 0, and a word not known.
ROW, ZERO, GAP = "\ue001", "\ue002", "\ue003"
_LATIN = "".join(map(chr, range(256)))


def _char(i: int) -> str:
    return chr(i) if i else ZERO


def _places(known: dict[str, str]) -> list[str]:
    """A hash table of the words (cuckoo hashing, a third full at most): each stands in one of two slots. One that finds none after
    many moves is left out."""
    slots = 1 << (3 * len(known)).bit_length()
    table = [""] * slots
    for word in known:
        at, moves = zlib.crc32(word.encode()) % slots, 0
        while word and moves < 100:
            word, table[at] = table[at], word
            code, moves = zlib.crc32(word.encode()), moves + 1
            at = (code >> 12) % slots if at == code % slots else code % slots
    return table


def _at(key: Column, slots: int) -> Column:
    return F.crc32(key).bitwiseAND(F.lit(slots - 1).cast("long")).cast("int")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


class RankMap:
    """The merges of a rank file in order of rank, from 1: the characters of each one's pair and of its token; for the checksum of a
    token's bytes, the merges that have it; for that of four bytes, the length of the longest token that begins so."""

    def __init__(self, ranks: dict[bytes, int]):
        if len({k for k in ranks if len(k) == 1}) != 256 or len(set(ranks.values())) != len(ranks) or max(ranks.values()) >= 0xD800:
            raise ValueError("a rank file has all 256 bytes and distinct ranks below 55296")
        pairs, merged, slots, reach = [""], [""], {}, [3] * STARTS
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                a, b = self._pair(ranks, token, rank)
                slots.setdefault(zlib.crc32(token) % SLOTS, []).append(chr(len(pairs)))
                pairs.append(_char(ranks[a]) + _char(ranks[b]))
                merged.append(_char(rank))
            if len(token) > 3:
                at = zlib.crc32(token[:4]) % STARTS
                reach[at] = max(reach[at], len(token))
        codes = [0] * SLOTS
        for k, slot in enumerate(slots, 1):
            codes[slot] = k
        self.texts = {"codes": ",".join(map(str, codes)), "reach": ",".join(map(str, reach))}
        self.texts |= {"found": ROW.join(["", *map("".join, slots.values())]), "pairs": ROW.join(pairs), "merged": ROW.join(merged)}
        self.start = "".join(_char(ranks[bytes([b])]) for b in range(256))
        pieces = [""] * (ord(ZERO) + 1)  # by the character's code
        for token, rank in ranks.items():
            pieces[ord(_char(rank))] = token.decode("latin-1")
        self.pieces = ROW.join(pieces)

    @staticmethod
    def _pair(ranks: dict[bytes, int], token: bytes, rank: int) -> list[bytes]:
        """What merges below ``rank`` leave of a token's bytes: its pair."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            found = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            k = found.index(min(found))
            if found[k] >= rank:
                raise ValueError(f"token {rank} is not made of one pair of tokens of lower rank")
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts


@lru_cache(4)
def rank_map(path: str) -> RankMap:
    with open(path, "rb") as f:
        return RankMap({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def words_of(text: Column, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The matches of the pattern; white space is Unicode's."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


def _arrays(texts: dict[str, Column]) -> Column:
    """The tables that tasks look things up in, from their texts."""
    return F.struct(*(F.split(v, ",").cast("array<int>").alias(k) if k in ("codes", "reach") else F.split(v, ROW).alias(k) for k, v in texts.items()))


def tables(spark: SparkSession, ranks: RankMap, known: dict[str, str] | None = None) -> Column:
    """The same as a scalar subquery, with the ``known`` words and their tokens. Higher-order functions take it as a column of the
    query below only."""
    words = _places({k: v for k, v in (known or {}).items() if ROW not in k})
    texts = ranks.texts | {"words": ROW.join(words), "tokens": ROW.join((known or {}).get(w, "") for w in words)}
    row = spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts))
    return stored(row.select(_arrays({k: F.col(k) for k in texts}).alias("tables")), "tables").scalar()


def fold(words: Column, ranks: RankMap, held: Column | None = None) -> Column:
    """The tokens of each word of an array, a character each, by the merges of ``BATCH`` words at a time in order of rank.
    ``held``: a column with ``tables``; without it, they are literals."""

    def found(raw: Column, held: Column) -> Column:
        many = F.length(raw)

        def codes(i: Column) -> Column:
            last = F.least(many - i + 1, F.get(held["reach"], _at(F.substring(raw, i, F.lit(4)), STARTS)))
            return F.filter(F.transform(F.sequence(F.lit(2), last), lambda n: F.get(held["codes"], _at(F.substring(raw, i, n), SLOTS))), lambda c: c > 0)

        return F.when(many > 1, F.flatten(F.transform(F.sequence(F.lit(1), many - 1), codes))).otherwise(F.array().cast("array<int>"))

    def folded(raws: Column, held: Column) -> Column:
        codes = F.array_distinct(F.flatten(F.transform(raws, lambda r: found(r, held))))
        merges = F.split(F.array_join(F.transform(codes, lambda c: F.get(held["found"], c)), ""), "")
        start = F.translate(F.array_join(F.transform(raws, lambda r: F.decode(r, "ISO-8859-1")), ROW), _LATIN, ranks.start)
        merge = lambda s, m: F.replace(s, F.get(held["pairs"], m), F.get(held["merged"], m))
        return F.split(F.aggregate(F.sort_array(F.transform(merges, F.ascii)), start, merge), ROW)

    def batches(words: Column, held: Column) -> Column:
        first = F.sequence(F.lit(1), F.size(words), F.lit(BATCH))
        done = F.transform(first, lambda i: _let(F.transform(F.slice(words, i, F.lit(BATCH)), lambda w: F.encode(w, "UTF-8")), lambda raws: folded(raws, held)))
        return F.when(F.size(words) > 0, F.flatten(done)).otherwise(F.array().cast("array<string>"))

    if held is None:
        held = _arrays({k: F.lit(v) for k, v in ranks.texts.items()})
    return _let(held, lambda held: _let(words, lambda words: batches(words, held)))  # not filtered anew for each batch


def dictionary(docs: DataFrame, ranks: RankMap, size: int = DICTIONARY) -> dict[str, str]:
    """The tokens of the most frequent words of all texts, at most ``size`` of them. Steps of the counts, not
    the words, are compared, so no task sees all words; words that occur once are left out."""
    words = docs.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and length(word) <= 64")
    words = stored(words.withColumn("step", F.floor(F.log2("n") * 16).cast("int")), "words")
    least, room = 1 << 30, size
    for r in words.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 16 rows a power of two
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    chosen = words.where(F.col("step") >= least).select("word", tables(docs.sparkSession, ranks).alias("held"))
    return {r.word: r.tokens for r in chosen.select("word", fold(F.array("word"), ranks, F.col("held"))[0].alias("tokens")).toLocalIterator()}


def tokens(text: Column, ranks: RankMap, held: Column) -> Column:
    """All tokens of a text, one a character. Words that ``held`` knows are looked up, the others folded and put into the gaps."""

    def looked_up(words: Column, held: Column, mask: Column) -> Column:
        def of(word: Column) -> Column:
            code = F.crc32(word.cast("binary"))
            first, second = (c.bitwiseAND(mask).cast("int") for c in (code, F.shiftright(code, 12)))
            known = F.when(F.get(held["words"], first) == word, F.get(held["tokens"], first))
            return known.when(F.get(held["words"], second) == word, F.get(held["tokens"], second)).otherwise(GAP)

        return F.transform(words, of)

    def filled(words: Column, hits: Column, held: Column) -> Column:
        rest = fold(F.filter(words, lambda w, i: F.get(hits, i) == GAP), ranks, held)
        return F.array_join(F.zip_with(F.split(F.array_join(hits, ""), GAP), rest, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    def encoded_(held: Column, mask: Column) -> Column:
        return _let(words_of(text), lambda words: _let(looked_up(words, held, mask), lambda hits: filled(words, hits, held)))

    return _let(held, lambda held: _let((F.size(held["words"]) - 1).cast("long"), lambda mask: encoded_(held, mask)))


def characters(tokens_: Column) -> Column:
    return F.when(tokens_ == "", F.array().cast("array<string>")).otherwise(F.split(tokens_, ""))


def ids(tokens_: Column) -> Column:
    """The ids as integers."""
    return F.transform(characters(tokens_), lambda c: F.when(c == ZERO, 0).otherwise(F.ascii(c)))


def id_bytes(tokens_: Column) -> Column:
    """The ids as little-endian unsigned 32-bit integers: each is below 65536, so its UTF-16 unit and a zero unit."""
    spread = F.concat(F.array_join(characters(tokens_), "\0"), F.when(tokens_ == "", "").otherwise("\0"))
    return F.encode(F.replace(spread, F.lit(ZERO), F.lit("\0")), "UTF-16LE")


def _joined(codes: Column, ranks: RankMap, of=lambda c: c) -> Column:
    """The bytes of the tokens with these character codes, concatenated; a code that is not in the file has none."""
    pieces = F.split(F.lit(ranks.pieces), ROW)
    return F.encode(F.array_join(F.transform(codes, lambda c: F.get(pieces, of(c))), ""), "ISO-8859-1")


def decoded(ids_: Column, ranks: RankMap) -> Column:
    """The bytes of all ids, concatenated; an id that is not in the file has none."""
    return _joined(F.transform(ids_, lambda i: F.when(i == 0, ord(ZERO)).otherwise(i)), ranks)


def decoded_tokens(tokens_: Column, ranks: RankMap) -> Column:
    """The same from the tokens of a text, one a character."""
    return _joined(characters(tokens_), ranks, F.ascii)


def encoded(docs: DataFrame, path: str, size: int = DICTIONARY) -> DataFrame:
    """(doc_id, tokens) for every row of ``docs(doc_id, text)``."""
    ranks = rank_map(path)
    held = tables(docs.sparkSession, ranks, dictionary(docs, ranks, size))
    return docs.select("doc_id", "text", held.alias("held")).select("doc_id", tokens(F.col("text"), ranks, F.col("held")).alias("tokens"))


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    done = encoded(documents(spark, sf_dir), path)
    return done.select(
        "doc_id", F.length("tokens").cast("long").alias("n_tokens"), F.sha2(id_bytes(F.col("tokens")), 256).alias("ids_sha256"),
        F.sha2(decoded_tokens(F.col("tokens"), rank_map(path)), 256).alias("decoded_sha256"),
    )
