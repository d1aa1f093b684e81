"""Language by cross-parsing: the language whose labelled text parses a text into the fewest phrases."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placard.llm.common import blocks, only_one, text_bytes
from placard.llm.training import remainder

#: Symbols of each language's labelled text, and of all languages' together: with more languages each has less, down to
#: the least. Bytes of a text in the sample.
SYMBOLS, ALL_SYMBOLS, LEAST_SYMBOLS, TEXT_BYTES = 60_000, 960_000, 2_000, 32_768
#: Symbols that are parsed side by side; what a longer text's segments miss of each other is mended afterwards.
SEGMENT = 512
BLOCK_BYTES = 1 << 21
#: How much a phrase less tells for a language, in natural logarithms of odds.
EVIDENCE = 0.5
#: Phrases for a byte from which on a text is like no language that was learned, and how many more it must have.
FOREIGN, SURPLUS = 0.7, 12
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")

# Symbols: 0 is padding, 1 anything that the labelled texts lack, 2 a digit, 3 a blank, 4 other ASCII signs; letters and
# bytes above 127 have one each.
_FOLD = np.full(256, 4, np.int32)
_FOLD[[0x20, *range(0x09, 0x0E)]] = 3
_FOLD[48:58] = 2
_FOLD[97:123] = np.arange(5, 31)
_FOLD[65:91] = np.arange(5, 31)
_FOLD[128:] = np.arange(31, 159)
_WIDTH = 160


def symbols_of(data: np.ndarray) -> np.ndarray:
    """Case-folded symbols of UTF-8 bytes (A to Z, and the capitals from U+00C0 to U+00DE)."""
    out = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


class SuffixAutomaton:
    """Accepts every substring of one sequence of symbols."""

    def __init__(self, sequence: list[int]):
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for symbol in sequence:
            new = len(moves)
            moves.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and symbol not in moves[at]:
                moves[at][symbol] = new
                at = link[at]
            if at >= 0:
                to = moves[at][symbol]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    twin = len(moves)
                    moves.append(dict(moves[to]))
                    link.append(link[to])
                    length.append(length[at] + 1)
                    link[to] = link[new] = twin
                    while at >= 0 and moves[at].get(symbol) == to:
                        moves[at][symbol] = twin
                        at = link[at]
            last = new
        self.moves = moves


class Parser:
    """Counts the phrases of texts by every language's automaton, many segments at a time.

    Most states have one move alone, which is kept as a symbol and a state; the others have a row of a dense table.
    An entry is twice the next state, plus 1 if the phrase broke there and a new one began with the symbol.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        most = symbols_each(len(samples))
        folded = [symbols_of(np.frombuffer(samples[x], np.uint8))[:most] for x in self.languages]
        met = np.unique(np.concatenate([np.zeros(0, np.int32), *folded]))
        self._dense = np.zeros(_WIDTH, np.int32)  # symbols that no language has share one
        self._dense[met] = np.arange(1, 1 + len(met))
        width, states = len(met) + 1, 0
        roots, own, to, rows, table = [], [], [], [], []
        for f in folded:
            moves = SuffixAutomaton(self._dense[f].tolist()).moves
            # The last state is that after a symbol which the sequence lacks: such a symbol is a phrase of its own.
            lost, first_row = states + len(moves), sum(map(len, table))
            begin = np.full(width, 2 * lost, np.int32)
            for symbol, next_ in moves[0].items():
                begin[symbol] = 2 * (states + next_)
            wide = [i for i, m in enumerate(moves) if i and len(m) > 1]
            part = np.repeat((begin + 1)[None], len(wide) + 2, 0)  # the first row breaks, the second is the root's
            part[1] = begin
            for row, i in zip(part[2:], wide, strict=True):
                for symbol, next_ in moves[i].items():
                    row[symbol] = 2 * (states + next_)
            own_symbol, own_next, row_of = np.full(len(moves) + 1, -1, np.int16), np.zeros(len(moves) + 1, np.int32), np.zeros(len(moves) + 1, np.int32)
            for i, m in enumerate(moves):
                if i and len(m) == 1:
                    ((own_symbol[i], next_),) = m.items()
                    own_next[i] = 2 * (states + next_)
            row_of[0], row_of[wide] = 1, np.arange(2, len(wide) + 2)
            roots.append(states)
            own.append(own_symbol)
            to.append(own_next)
            rows.append((first_row + row_of) * width)
            table.append(part)
            states += len(moves) + 1
        none = np.zeros(0, np.int32)
        self._roots = np.array(roots, np.int32)
        self._own, self._to, self._rows = np.concatenate([none.astype(np.int16), *own]), np.concatenate([none, *to]), np.concatenate([none, *rows]).astype(np.int32)
        self._table = np.concatenate([none, *(t.ravel() for t in table)])
        self._weights = np.array([np.log2(max(2, len(f))) for f in folded])

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one symbol more, and whether a phrase began with it."""
        found = np.where(self._own.take(state) == symbol, self._to.take(state), self._table.take(self._rows.take(state) + symbol))
        return found >> 1, (found & 1).astype(bool)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (row) by each language (column); an empty text has none.

        Segments are parsed as if each were a text. Then the phrase that is open at a segment's end goes on into the
        next one until both parses begin a phrase at the same symbol: from there on they are the same. Texts whose
        parses don't meet within a segment (they repeat themselves) are parsed once more, symbol by symbol.
        """
        offsets = offsets - offsets[0]
        lengths, k = np.diff(offsets), len(self.languages)
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(lengths)), pieces)
        if not len(owner) or not k:
            return np.zeros((len(lengths), k), np.int64)
        symbols = self._dense[symbols_of(data)]
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = offsets[owner] + piece * SEGMENT
        size = np.minimum(SEGMENT, lengths[owner] - piece * SEGMENT)
        begins = np.zeros((k, len(data)), bool)
        own, state = self._lockstep(symbols, first, size, begins)
        total = np.stack([np.bincount(owner, c, len(lengths)) for c in own], 1).astype(np.int64)
        follows = np.flatnonzero(piece > 0)
        if not len(follows):
            return total
        # Carried on: what an open phrase makes of the next segment, against that segment's own parse.
        language, at = (g.ravel() for g in np.meshgrid(np.arange(k), follows, indexing="ij"))
        now, place, end = state[language, at - 1], first[at], first[at] + size[at]
        more, text = np.zeros(len(at), np.int64), owner[at]
        row = np.arange(len(at))
        apart: set[tuple[int, int]] = set()
        while len(row):
            now, broke = self._step(now, symbols[place])
            own_too = begins[language[row], place]
            more[row] += broke.astype(np.int64) - own_too
            met = broke & own_too
            place = place + 1
            lost = ~met & (place == end[row])
            apart.update(zip(text[row[lost]].tolist(), language[row[lost]].tolist(), strict=True))
            go = ~met & ~lost
            row, now, place = row[go], now[go], place[go]
        np.add.at(total, (text, language), more)
        for t, x in apart:
            total[t, x] = self._one_by_one(symbols[offsets[t] : offsets[t + 1]], x)
        return total

    def _one_by_one(self, symbols: np.ndarray, language: int) -> int:
        own, to, rows, table = map(memoryview, (self._own, self._to, self._rows, self._table))
        state, count = int(self._roots[language]), 1
        for symbol in memoryview(symbols):
            found = to[state] if own[state] == symbol else table[rows[state] + symbol]
            state = found >> 1
            count += found & 1
        return count

    def _lockstep(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and last states of stretches (columns) by languages (rows); ``begins`` gets where phrases begin."""
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        state, counts = np.repeat(self._roots[:, None], len(size), 1), np.ones((len(self._roots), len(size)), np.int64)
        begins[:, first] = True
        for step in range(int(size[0])):
            open_ = len(size) - int(np.searchsorted(size[::-1], step, "right"))
            at = first[:open_] + step
            state[:, :open_], broke = self._step(state[:, :open_], symbols[at])
            counts[:, :open_] += broke
            begins[:, at] |= broke
        back = np.argsort(order)
        return counts[:, back], state[:, back]

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """``counts`` times the logarithm of the language's sample over the mean of these logarithms."""
        return self.counts(data, offsets) * (self._weights / self._weights.mean() if len(self._weights) else self._weights)


def symbols_each(languages: int) -> int:
    return max(LEAST_SYMBOLS, min(SYMBOLS, ALL_SYMBOLS // max(1, languages)))


def verdict_of(spark: SparkSession, samples: dict[str, bytes], text: Column) -> Column:
    """lang_pred, score and phrases (by the language that won) of a text column.

    ``samples``: labelled text of each language, bounded by ``symbols_each``; a worker builds the automata once.
    """
    kept = spark.sparkContext.broadcast(samples)
    key = zlib.crc32(repr(sorted(samples.items())).encode())

    @F.arrow_udf("lang_pred string, score double, phrases double")
    def judge(column: pa.Array) -> pa.Array:
        parser = only_one("languages", key, lambda: Parser(kept.value))
        offsets, data = text_bytes(column)
        names: list[str] = []
        scores, phrases = [np.zeros(0)], [np.zeros(0)]
        for a, b in blocks(offsets, BLOCK_BYTES):
            counts = parser.phrases(data[offsets[a] : offsets[b]], offsets[a : b + 1])
            spoken = np.array([bool(t) and _LETTER.search(t) is not None for t in column.slice(a, b - a).to_pylist()], bool)
            if not parser.languages:
                counts, spoken[:] = np.zeros((b - a, 1)), False
            least = counts.min(1)
            odds = np.exp(-EVIDENCE * (counts - least[:, None])).sum(1)
            names += [parser.languages[i] if s else UNDETERMINED for i, s in zip(counts.argmin(1), spoken, strict=True)]
            scores.append(np.where(spoken, 1 / odds, 0.0))
            phrases.append(np.where(spoken, least, 0.0))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(phrases))], ["lang_pred", "score", "phrases"])

    return judge(text)


def judged(docs: DataFrame, samples: dict[str, bytes], held_out: Column) -> DataFrame:
    """Language of every whole text of ``docs(doc_id, text)``, in one pass without a shuffle.

    A text is parsed greedily: each phrase is the longest match in a language's text, and the language with the
    fewest phrases wins, ties to the smaller name. ``score`` is the share of odds that its lead gives it.

    Rows: a null text, or one without a letter, is ``und`` with score 0, and so is any text if there are no
    samples; repeated rows and null ids pass through (``held_out`` of a null id is false); an empty table gives no rows;
    other columns are ignored.

    Returns doc_id, held_out, lang_pred, score, phrases.
    """
    verdict = verdict_of(docs.sparkSession, samples, F.col("text")).alias("v")
    return docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), verdict).select("doc_id", "held_out", "v.*")


def spoken(docs: DataFrame, samples: dict[str, bytes], most_phrases: float = FOREIGN, surplus: float = SURPLUS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language: not ``und``, and not so unlike all
    languages that it has ``surplus`` phrases more than ``most_phrases`` for a byte (random letters do; short texts can't).

    Rows: null and empty texts and texts without letters go; null ids and repeated rows are judged like any other; an
    empty table, or no samples, gives no rows.
    """
    name = "verdict"
    while name in docs.columns:
        name += "_"
    found = docs.withColumn(name, verdict_of(docs.sparkSession, samples, F.col("text")))
    like = F.col(f"{name}.phrases") < F.octet_length("text") * most_phrases + surplus
    return found.filter((F.col(f"{name}.lang_pred") != UNDETERMINED) & like).select(*(F.col(f"`{c}`") for c in docs.columns))


def labelled_text(docs: DataFrame, learned: Column) -> dict[str, bytes]:
    """Joined texts of every language of the rows that ``learned`` lets in: ``symbols_each`` bytes of it at most.

    Different texts are chosen by hash of their smallest id, those of 400 to 4,000 bytes first and none above
    ``TEXT_BYTES``; they are taken whole, only the last one is cut at the bound.
    """
    usable = docs.filter(learned & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.select("doc_id", "lang", "text", F.octet_length("text").cast("long").alias("bytes")).filter(F.col("bytes").between(1, TEXT_BYTES))
    known = usable.groupBy("lang", F.xxhash64("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.min("bytes").alias("bytes"))
    known = known.groupBy("lang", "doc_id").agg(F.min(F.struct("bytes", "digest")).alias("b")).select("lang", "doc_id", "b.bytes", "b.digest")  # an id may have many texts
    counts = known.groupBy("lang").agg(F.count("*").alias("texts"))  # a row for each language
    most = symbols_each(counts.count())
    places = most // 64  # enough unless all are tiny
    # Of many texts only those with low hashes are ordered, some times as many as there are places.
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("texts") < F.lit(4 * places << 30)
    few = known.join(F.broadcast(counts), "lang").filter(low).drop("texts")
    order = Window.partitionBy("lang").orderBy(~F.col("bytes").between(400, 4000), F.xxhash64("doc_id"), "doc_id")
    picks = few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= places)
    picks = picks.withColumn("before", F.sum("bytes").over(Window.partitionBy("lang").orderBy("place")) - F.col("bytes")).filter(F.col("before") < most)
    chosen = usable.withColumn("digest", F.xxhash64("text")).join(F.broadcast(picks.select("doc_id", "lang", "digest", "place")), ["doc_id", "lang", "digest"])
    rows = chosen.groupBy("lang", "place").agg(F.min("text").alias("text")).toPandas()  # rows may be repeated
    out: dict[str, bytes] = {}
    for lang, group in rows.sort_values(["lang", "place"], kind="stable").groupby("lang"):
        out[lang] = b"\n".join(t.encode("utf-8") for t in group.text)[:most]
    return out


def learned_and_judged(docs: DataFrame) -> DataFrame:
    """Learns from a bounded sample of ``docs(doc_id, text, lang)`` outside the held-out fifth of ids; judges all rows.

    Rows are as in ``judged``; null ids are judged, but neither learned from nor held out; a null lang teaches nothing; without any
    lang every text is ``und``; an empty table gives no rows. Of languages with equally many phrases the first by name wins.
    """
    held_out = remainder(F.col("doc_id"), 5) == 0
    return judged(docs, labelled_text(docs, ~held_out), held_out)
