"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded sample of labelled text. A text
is cut into phrases, each the longest match (at least one symbol) in the language's
training text; the language that needs the fewest phrases, normalised by the bits that
name a place in its training text, wins.

Training text is bounded: ``buckets`` texts a language (those with the least hash in
each of as many hash buckets), ``chars`` characters of each, ``symbols`` in all. All
texts are scored whole. For speed an automaton is one table, (state, symbol) -> next
state and whether a new phrase begins, and texts are parsed in blocks of BLOCK symbols
that advance in step, all languages at once. A block begins as if a phrase ended there; a
second pass goes on from the state that the block before really ends in until both are in one state,
from where on they agree, and counts what they differ by. So the phrases are those of the whole text.
The table has columns for the CLASSES most frequent symbols; moves by the others are looked up
among sorted keys.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CLASSES, BLOCK, SLICE = 64, 512, 1 << 20
UNKNOWN = "und"
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])
    return _LETTERS


def alphabet(samples: dict[str, str]) -> np.ndarray:
    """Code point -> symbol: 0 no letter, 1 a letter never seen, 2 on each letter of the
    samples, the frequent ones first, upper and lower case alike."""
    seen = Counter(c for t in samples.values() for c in t.lower() if letters()[ord(c)])
    table = letters().astype(np.min_scalar_type(len(seen) + 1))
    for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))):
        table[ord(c)] = i + 2
        for x in {c.upper(), c.title()}:
            if len(x) == 1 and table[ord(x)] == 1:  # a capital of two letters is the frequent one's
                table[ord(x)] = i + 2
    return table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts and the first of each."""
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), off


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, runs of 0 as one, and the first symbol of each text."""
    points, off = code_points(texts)
    s = table[points]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    keep[off[:-1][off[:-1] < len(s)]] = True
    return s[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of text; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Model:
    """The automata of all languages as one table, and the moves by symbols beyond it."""

    def __init__(self, samples: dict[str, str], limit: int):
        self.langs = sorted(samples)
        self.symbol = alphabet(samples)
        tables, self.start, self.bits, base = [], [], [], 0
        self.symbols = max(CLASSES, int(self.symbol.max()) + 1)
        self.fresh = np.zeros((len(self.langs), self.symbols - CLASSES), np.int32)
        far: dict[int, int] = {}  # state * symbols + symbol -> move
        for i, lang in enumerate(self.langs):
            self.fresh[i] = 2 * base + 1
            text = symbols([samples[lang]], self.symbol)[0][:limit]
            nxt = automaton(text)
            # state 0 stands before a phrase: every way out of it begins one
            table = np.full((len(nxt) + 1, CLASSES), -1, np.int64)
            for s, out in enumerate(nxt):
                for c, t in out.items():
                    if c < CLASSES:
                        table[s + 1, c] = 2 * (base + t + 1)
                    else:
                        far[(base + s + 1) * self.symbols + c] = 2 * (base + t + 1)
                        if s == 0:
                            self.fresh[i, c - CLASSES] = 2 * (base + t + 1) + 1
            fresh = np.where(table[1] < 0, 2 * base, table[1]) + 1
            table = np.where(table < 0, fresh, table)
            table[0] = fresh
            tables.append(table.astype(np.int32))
            self.start.append(base)
            self.bits.append(np.log2(max(2, len(text))))
            base += len(table)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.keys = np.array(sorted(far), np.int64)
        self.moves = np.array([far[k] for k in self.keys.tolist()], np.int32)

    def far(self, state: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Moves by symbols without a column: of the automaton, else to a new phrase."""
        out = self.fresh[:, s.astype(np.int64) - CLASSES]
        if len(self.keys):
            key = state.astype(np.int64) * self.symbols + s
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where(self.keys[at] == key, self.moves[at], out)
        return out

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(language, text): the number of phrases."""
        s, off = symbols(texts, self.symbol)
        n = np.diff(off)
        per = -(-n // BLOCK)
        doc = np.repeat(np.arange(len(texts)), per)
        at = off[:-1][doc] + (np.arange(len(doc)) - (np.cumsum(per) - per)[doc]) * BLOCK
        length = np.minimum(BLOCK, off[1:][doc] - at)
        order = np.argsort(-length, kind="stable")
        at, length = at[order], length[order]
        live = np.searchsorted(-length, -np.arange(BLOCK), "left")  # blocks longer than each step
        state = np.repeat(np.array(self.start, np.int32)[:, None], len(at), 1)
        count = np.zeros(state.shape, np.int32)
        for step in range(int(length[0]) if len(length) else 0):
            m = live[step]
            c = s[at[:m] + step]
            if self.symbols > CLASSES:
                move = self.table[state[:, :m] * CLASSES + np.minimum(c, CLASSES - 1)]
                if len(beyond := np.flatnonzero(c >= CLASSES)):
                    move[:, beyond] = self.far(state[:, beyond], c[beyond])
            else:
                move = self.table[state[:, :m] * CLASSES + c]
            count[:, :m] += move & 1
            state[:, :m] = move >> 1
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        count, state = count[:, back], state[:, back]  # blocks in the order of the text again
        count += self.borders(s, off[:-1][doc] + (np.arange(len(doc)) - (np.cumsum(per) - per)[doc]) * BLOCK, length[back], doc, state)
        out = np.zeros((len(self.langs), len(texts)))
        for i in range(len(self.langs)):
            out[i] = np.bincount(doc, count[i], len(texts))
        return out

    def step(self, lang: np.ndarray, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Moves of single states by single symbols."""
        move = self.table[state.astype(np.int64) * CLASSES + np.minimum(c, CLASSES - 1)]
        if self.symbols > CLASSES and len(beyond := np.flatnonzero(c >= CLASSES)):
            far = self.fresh[lang[beyond], c[beyond].astype(np.int64) - CLASSES]
            if len(self.keys):
                key = state[beyond].astype(np.int64) * self.symbols + c[beyond]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                far = np.where(self.keys[at] == key, self.moves[at], far)
            move[beyond] = far
        return move

    def borders(self, s: np.ndarray, at: np.ndarray, length: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(language, block): phrases to add to a block's count because the block before it ends inside a
        phrase. ends: the state that each block ends in if a phrase begins with it. A block that never meets
        that parse ends otherwise, and the next one is looked at again: as many rounds as such
        blocks follow each other."""
        more, true = np.zeros(ends.shape, np.int32), ends.copy()
        follows = np.zeros(len(doc) + 1, bool)
        follows[1:-1] = doc[1:] == doc[:-1]
        block = np.tile(np.flatnonzero(follows[:-1]), len(self.langs))
        lang = np.repeat(np.arange(len(self.langs)), int(follows.sum()))
        start = np.array(self.start, np.int32)
        while len(block):
            i, k, carry, fresh = lang, block, true[lang, block - 1], start[lang]
            delta, new = np.zeros(len(k), np.int32), ends[lang, block]
            place = np.arange(len(k))  # of those that still differ, in new and delta
            for n in range(BLOCK):
                go = n < length[k]
                if not go.all():
                    new[place[~go]] = carry[~go]
                    i, k, carry, fresh, place = i[go], k[go], carry[go], fresh[go], place[go]
                if not len(k):
                    break
                c = s[at[k] + n]
                a, b = self.step(i, carry, c), self.step(i, fresh, c)
                delta[place] += (a & 1) - (b & 1)
                carry, fresh = a >> 1, b >> 1
                apart = carry != fresh
                i, k, carry, fresh, place = i[apart], k[apart], carry[apart], fresh[apart], place[apart]
            new[place] = carry
            more[lang, block] = delta
            changed = (new != true[lang, block]) & follows[block + 1]
            true[lang, block] = new
            lang, block = lang[changed], block[changed] + 1
        return more

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. Score: the runner-up's cost over the cost of
        both, so 0.5 is a tie; 1 if one language was learned; 0 for `und`."""
        known = [t or "" for t in texts]
        points, off = code_points(known)
        have = np.concatenate([[0], np.cumsum(letters()[points])])[off]
        lettered = np.diff(have) > 0
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cost = self.phrases(known) * np.array(self.bits)[:, None]
        best = cost.argmin(0)
        least = cost.min(0)
        second = np.sort(cost, 0)[1] if len(self.langs) > 1 else np.ones(len(texts))
        score = second / np.maximum(second + (least if len(self.langs) > 1 else 0), 1e-300)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 64, chars: int = 2048, limit: int = 24_000) -> Model:
    """Fit on a bounded sample of labelled rows: buckets * chars characters a language
    come to the driver, of which limit symbols are learned. Null texts or labels are left
    out; a language without text isn't learned. Equal texts are one; of texts with one hash bucket the
    least hash counts, so reruns agree. Without rows no language is learned. The model takes some
    12 MB a language on each worker, as many as the labels tell apart."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    picked = rows.groupBy("lang", F.pmod("h", F.lit(buckets)).alias("b")).agg(F.min("h").alias("h")).select("lang", "h")
    got = rows.join(F.broadcast(picked), ["lang", "h"]).select("lang", "h", F.substring("text", 1, chars).alias("text")).distinct().collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(got):
        samples.setdefault(r.lang, []).append(r.text)
    return Model({k: "\n".join(v) for k, v in samples.items() if any(letters()[ord(c)] for t in v for c in t)}, limit)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score. `und` and 0 if the text is null, empty or has no
    letter, or no language is learned. Texts of any length are scored whole; of languages that need
    equally much, the first by name wins. Each row is judged alone, so repeated rows get equal
    answers; an empty table gives no rows. Columns of docs by these names are replaced, all others
    pass through."""
    common.ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train's parameters
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            column, langs, scores = batch.column(at), [], []
            lo = 0
            while lo < len(column):
                some, n = [], 0
                while lo < len(column) and n < SLICE:
                    some.append(column[lo].as_py())
                    n += len(some[-1] or "")
                    lo += 1
                got = held.value.predict(some)
                langs += got[0]
                scores.append(got[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(common.trimmed(run), schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE: dict[str, str] = {}
