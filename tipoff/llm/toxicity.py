"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that part quotation from abuse.

The lexicon is learned from labelled rows: words, and stems shared by several words, that stand in many different toxic documents and
hardly in others. Copies of a document count once there. The lexicon's trie and the Levenshtein automata of its terms are walked
together, as one automaton that is determinised on demand; a word is in it if a term lies within the edits that the term's length allows.
Each hit is looked at in a window of words: quotation marks, reporting words and words of address tell quoting from abuse. A logistic
model of counts of hits by kind, fitted on the same rows with PRIOR as its prior, gives the score.

At most POSITIVE toxic and NEGATIVE other labelled ids are learned from, those with the least xxhash64; of an id's texts, the least. Their
words are counted by Spark: the driver holds terms, and of each such row eight numbers and FEATURES. Null and empty
texts have no hits and get the score of such texts. Without toxic rows the lexicon is empty. An id with several labels counts once, with the
greatest; labels of null ids and null labels are left out. Texts are read whole, whatever their length; repeated rows are scored each. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import bucket_of, map_batches, written
from tipoff.llm.near_dedup import _sets_of, band_keys, minima

POSITIVE, NEGATIVE = 3000, 6000
#: A term stands in this share of the toxic documents at least, in MIN_DOCS of them, and LIFT times as often as elsewhere.
MIN_SHARE, MIN_DOCS, LIFT = 0.008, 3, 25
#: A term is matched with edits only if these lead to it in no more than this share of other documents.
FUZZY_SHARE = 0.0005
SHORTEST, STEMS = 4, (4, 5, 6, 7)
WINDOW = 6
MEMO = 400_000

# Words of address and of reporting in four languages, and quotation marks.
ADDRESS = frozenset("you your yours youre u ya du dich dir dein deine ihr euch sie tu te toi ton ta vous votre vos usted ustedes ti tus su vosotros".split())
REPORT = frozenset("said says say quote quoted quotes wrote writes called word term sagte sagt schrieb zitat zitiert wort dit écrit cité citation mot dijo dice escribió cita palabra término".split())
QUOTES = frozenset("\"“”„«»‟‹›")

_WORD = re.compile(r"[^\W_]+")
FEATURES = ("any_plain", "any_fuzzy", "any_quoted", "plain", "fuzzy", "quoted", "address", "terms", "density")
PRIOR = np.array([-5.0, 3.0, 1.5, 0.3, 1.0, 0.7, 0.1, 0.5, 0.7, 10.0])


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Automaton:
    """Trie of terms x Levenshtein automata, determinised on demand. A state is a set of (trie node, edits spent)."""

    def __init__(self, terms: dict[str, tuple[int, bool]]):
        """terms: term -> (edits allowed, whether the term is a stem, which any ending may follow)."""
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[str, int, bool]] = {}
        self.allowed = [0]
        for term, (edits, stem) in sorted(terms.items()):
            node = 0
            self.allowed[0] = max(self.allowed[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits)
            self.ends[node] = (term, edits, stem)
        self.states: dict[frozenset, int] = {frozenset(): 0}
        self.items: list[frozenset] = [frozenset()]
        self.moves: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[str, int] | None] = [None]
        self.stems: list[tuple[str, int] | None] = [None]
        self.start = self._state({(0, 0)})
        self.memo: dict[str, tuple[str, int] | None] = {}

    def _state(self, items: set[tuple[int, int]]) -> int:
        todo, best = list(items), {}
        while todo:  # a term's letter may be missing in the word
            node, e = todo.pop()
            if e > self.allowed[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.items)
            self.items.append(key)
            self.moves.append({})
            hits = sorted((e, *self.ends[n]) for n, e in key if n in self.ends and e <= self.ends[n][1])
            self.accepts.append((hits[0][1], hits[0][0]) if hits else None)
            stems = [h for h in hits if h[3]]
            self.stems.append((stems[0][1], stems[0][0]) if stems else None)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.items[state]:
            out.add((node, e + 1))
            out |= {(child, e + (x != c)) for x, child in self.children[node].items()}
        self.moves[state][c] = to = self._state(out)
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest (term, edits) that the word is, or whose stem it begins with."""
        state, moves, stem = self.start, self.moves, None
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if not state:
                return stem
            if (s := self.stems[state]) and (stem is None or s[1] < stem[1]):
                stem = s
        hit = self.accepts[state]
        return hit if stem is None or hit and hit[1] <= stem[1] else stem

    def hits(self, words: set[str]) -> dict[str, tuple[str, int]]:
        memo, out = self.memo, {}
        for w in words:
            try:
                hit = memo[w]
            except KeyError:
                hit = self.find(w)
                if len(memo) >= MEMO:
                    memo.clear()
                memo[w] = hit
            if hit:
                out[w] = hit
        return out


def features(text: str | None, automaton: Automaton) -> list[float]:
    """FEATURES of one whole text."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    found = automaton.hits(set(words))
    if not found:
        return [0.0] * len(FEATURES)
    spans = [(m.start(), m.end()) for m in _WORD.finditer(low)]
    marks = np.cumsum([0, *(c in QUOTES for c in low)]) if not QUOTES.isdisjoint(low) else None
    plain = fuzzy = quoted = address = 0
    for k, w in enumerate(words):
        if w not in found:
            continue
        near = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
        a, b = spans[max(0, k - WINDOW)][0], spans[min(len(spans) - 1, k + WINDOW)][1]
        enclosed = marks is not None and marks[spans[k][0]] > marks[max(0, a - 1)] and marks[min(len(low), b + 1)] > marks[spans[k][1]]
        addressed = any(x in ADDRESS for x in near)
        if (enclosed or any(x in REPORT for x in near)) and not (addressed and not enclosed):
            quoted += 1
        elif found[w][1]:
            fuzzy += 1
        else:
            plain += 1
        address += addressed
    terms = len({t for t, _ in found.values()})
    return [float(plain > 0), float(fuzzy > 0), float(quoted > 0), *np.log1p([plain, fuzzy, quoted, address, terms]).tolist(), (plain + 0.5 * fuzzy) / len(words)]


Terms = dict[str, tuple[int, bool]]


def _lexicon(words: set[str], stems: dict[str, int], forms: dict[str, set[str]]) -> Terms:
    """Terms of the words and stems that stand in toxic documents above all; stems: how many groups hold each; forms: words of each stem."""
    kept: list[str] = []
    for s in sorted(stems, key=len):
        longer = [t for t in stems if len(t) == len(s) + 1 and t.startswith(s)]
        if len(forms[s]) >= 3 and not any(s.startswith(k) for k in kept) and not any(stems[t] >= 0.9 * stems[s] for t in longer):
            kept.append(s)
    # the forms of a stem stay beside it with their own edits; the stem has those of its shortest form
    terms = {w: (edits_for(w), False) for w in words | {w for s in kept for w in forms[s]}}
    for s in kept:
        terms[s] = (edits_for(s if s in words else min(forms[s], key=len)), True)
    return terms


def _without_common(terms: Terms, near: Callable[[Terms], dict[str, int]], negatives: int) -> Terms:
    """A term whose misspellings are words of other documents (near(terms): how many have them) is matched as it is written; another term
    may then be the nearest to them."""
    while True:
        common = {t for t, n in near(terms).items() if n > FUZZY_SHARE * negatives}
        if not common:
            return terms
        terms = terms | {t: (0, terms[t][1]) for t in common}


def learned_terms(positive: list[tuple[set[str], int]], negative: list[set[str]]) -> Terms:
    """The rule of counted_terms() over rows at hand: (words of a toxic document, its group of copies), words of others. Tests hold both
    against each other."""
    groups = len({g for _, g in positive})
    need = max(MIN_DOCS, MIN_SHARE * groups)

    def held(names) -> dict[str, int]:
        by = defaultdict(set)
        for words, g in positive:
            for x in names(words):
                by[x].add(g)
        by = {x: len(gs) for x, gs in by.items() if len(gs) >= need}
        against = Counter(x for words in negative for x in names(words) if x in by)
        return {x: n for x, n in by.items() if n / groups >= LIFT * (against[x] + 0.3) / max(1, len(negative))}

    words = held(lambda ws: {w for w in ws if len(w) >= SHORTEST and not w.isdigit()})
    stems = held(lambda ws: {w[:n] for w in ws for n in STEMS if len(w) > n and w.isalpha()})
    forms = defaultdict(set)
    for ws, _ in positive:
        for w in ws:
            for n in STEMS:
                if len(w) > n and w[:n] in stems:
                    forms[w[:n]].add(w)

    def near(terms: Terms) -> Counter:
        automaton, out = Automaton(terms), Counter()
        for ws in negative:
            out.update({t for t, edits in automaton.hits(ws).values() if edits})
        return out

    return _without_common(_lexicon(set(words), stems, forms), near, len(negative))


def counted_terms(rows: DataFrame, groups: DataFrame, n_groups: int, negatives: int) -> Terms:
    """rows: id, label, words (a document's different words); groups: id, owner (the group of copies of a toxic document). Words and stems are
    counted by Spark, so only those over the thresholds, and the forms of such stems, reach the driver, however long the documents are."""
    spark = rows.sparkSession
    w = F.col("word")
    owned = rows.join(F.broadcast(groups), "id", "left").select("label", F.coalesce(F.col("owner").cast("string"), F.col("id").cast("string")).alias("owner"), F.explode("words").alias("word"))
    whole = F.when((F.length(w) >= SHORTEST) & ~w.rlike(r"^\p{Nd}+$"), F.struct(F.lit(False).alias("stem"), w.alias("name")))
    begun = [F.when((F.length(w) > n) & w.rlike(r"^\p{L}+$"), F.struct(F.lit(True).alias("stem"), F.substring(w, 1, n).alias("name"))) for n in STEMS]
    each = owned.select("label", "owner", F.explode(F.array_compact(F.array(whole, *begun))).alias("x")).select("label", "owner", "x.*").distinct()
    held = each.groupBy("stem", "name").agg(F.sum("label").alias("held"), F.sum(1 - F.col("label")).alias("against"))
    least = LIFT * (F.col("against") + 0.3) / max(1, negatives)
    over = held.filter((F.col("held") >= max(MIN_DOCS, MIN_SHARE * n_groups)) & (F.col("held") / max(1, n_groups) >= least)).collect()
    words, stems, forms = {r["name"] for r in over if not r["stem"]}, {r["name"]: r["held"] for r in over if r["stem"]}, defaultdict(set)
    if stems:
        asked = spark.createDataFrame([(s,) for s in sorted(stems)], "stem string")
        begins = F.explode(F.array_compact(F.array(*(F.when(F.length(w) > n, F.substring(w, 1, n)) for n in STEMS)))).alias("stem")
        found = rows.filter("label = 1").select(F.explode("words").alias("word")).distinct().select("word", begins)
        for r in found.join(F.broadcast(asked), "stem").select("stem", "word").distinct().toLocalIterator():
            forms[r["stem"]].add(r["word"])

    def near(terms: Terms) -> dict[str, int]:
        def make():
            automaton = Automaton(terms)

            def step(batch):
                hits = [{t for t, edits in automaton.hits(set(ws)).values() if edits} for ws in batch.column(0).to_pylist()]
                return pa.RecordBatch.from_arrays([pa.array([t for h in hits for t in h], pa.string())], ["term"])

            return step

        return {r["term"]: r["count"] for r in map_batches(rows.filter("label = 0").select("words"), make, "term string").groupBy("term").count().collect()}

    return _without_common(_lexicon(words, stems, forms), near, negatives)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps to the most likely weights under a Gaussian prior around PRIOR."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _copies(bands: list[list[int]]) -> list[int]:
    """Group numbers: documents that share a band are one group."""
    parent = list(range(len(bands)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    seen: dict[int, int] = {}
    for i, keys in enumerate(bands):
        for k in keys:
            parent[root(i)] = root(seen.setdefault(k, i))
    return [root(i) for i in range(len(bands))]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text"):
    """(terms, weights) from labelled rows whose crc32(id as text) mod folds is not held_out."""
    usable = labels.filter(F.col(label_col).isNotNull() & (bucket_of(F.col(id_col), folds) != held_out)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    order = (F.xxhash64("id"), "id")
    sample = usable.filter("label = 1").orderBy(*order).limit(POSITIVE).unionByName(usable.filter("label = 0").orderBy(*order).limit(NEGATIVE))
    kind = docs.schema[id_col].dataType.simpleString()
    # one text an id, so a repeated id adds no rows
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def make():
        def step(batch):
            texts = batch.column(2).to_pylist()
            values, first = _sets_of(texts, 3)
            bands = [band_keys(minima(values[a:b], np.array([0]), 24), 8, 3)[0].tolist() if b > a else [] for a, b in zip(first[:-1], first[1:], strict=True)]
            words = [sorted(set(_WORD.findall((t or "").lower()))) for t in texts]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string())), pa.array(bands, pa.list_(pa.int64()))], ["id", "label", "text", "words", "bands"])

        return step

    rows = written(map_batches(picked, make, f"id {kind}, label int, text string, words array<string>, bands array<long>"), "toxicity-sample")
    toxic = rows.filter("label = 1").select("id", "bands").orderBy("id").collect()
    owner = _copies([r["bands"] for r in toxic])
    groups = rows.sparkSession.createDataFrame(list(zip((r["id"] for r in toxic), owner, strict=True)), f"id {kind}, owner long")
    terms = counted_terms(rows.select("id", "label", "words"), groups, len(set(owner)), rows.filter("label = 0").count())
    table = _featured(rows.select("label", "text"), terms).toArrow()
    x, y = np.array(table["x"].to_pylist()).reshape(-1, len(FEATURES)), np.array(table["label"].to_pylist(), float)
    order2 = np.lexsort((y, *x.T))
    return terms, fit_logistic(x[order2], y[order2])


def _featured(rows: DataFrame, terms: dict) -> DataFrame:
    def make():
        automaton = Automaton(terms)

        def step(batch):
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t, automaton) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["label", "x"])

        return step

    return map_batches(rows, make, "label int, x array<double>")


def scored(docs: DataFrame, terms: dict, weights: np.ndarray, threshold: float = 0.7, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted."""

    def make():
        automaton = Automaton(terms)

        def step(batch):
            x = np.array([features(t, automaton) for t in batch.column(1).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

        return step

    out = map_batches(docs.select(id_col, text_col), make, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
    return out.select(id_col, (bucket_of(F.col(id_col), folds) == held_out).alias("held_out"), "score", "predicted")
