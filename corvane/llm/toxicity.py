"""Toxicity by a misspelling-tolerant lexicon with context scores.

A lexicon is kept as a trie. Each distinct word of a batch is turned into a
Levenshtein automaton that is intersected with the trie, so misspelled terms
are found without listing them. Every hit is weighed by its context window:
inside quotation marks or next to a verb of reporting it counts less, next to
a second-person pronoun more. A document is toxic from ``THRESHOLD`` on.

The lexicon is a given list, whose terms weigh 1, plus words and stems with
fitted weights, which add up over distinct words, learned from at most
``MAX_LABELLED`` labelled documents of ``MAX_BYTES`` together (the least hashes
of their ids; these bounds are the fit's only limits). Scanning covers every word of every document.

Defined results: a null text counts as empty; an empty text scores 0; repeated
rows are scored each; an empty table or one without usable labels leaves the
given list; a null label is ignored. Columns besides id and text play no part.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._common import col
from corvane.llm._vector import column, mix, ngrams, slices, strings, trim, word_hashes, words

TERMS = ("idiot", "moron", "stupid", "loser", "pathetic", "scum", "worthless", "trash", "clown", "disgusting", "imbecile", "dumbass", "bastard", "asshole", "retard", "vermin", "subhuman")
MAX_LABELLED = 10_000
MAX_BYTES = 64 << 20
#: Distinct words whose match a task remembers; forgotten ones are matched again.
REMEMBERED = 4_000_000
THRESHOLD = 1.0
QUOTED, REPORTED, ADDRESSED = 0.25, 0.5, 1.5
#: For misspellings of learned evidence: its forms are many, and their ordinary neighbours too.
FUZZY = 0.4
WINDOW = 8
#: Learned weights: folds that calibrate them, and standard errors by which a ratio is lowered.
FOLDS, Z = 5, 1.64
#: Words within the allowance of a given term that aren't misspellings of it.
ORDINARY = (
    "closer lower loses lose losen losem looser leser löser laser loner lover poser doser oser louer loger loper moser crash brash thrash rash crown blown flown lown scam slum swum scrum scud scut sum idiom "
    "moon morn boron mormon morton myron moroni moran moros mouron maron apathetic empathetic bathetic athletic mirthless wordless toothless mouthless worthies worthiest "
    "discussing disputing disrupting distrusting disguising degusting digesting disusing regard petard retarde bustard dastard termin vermis verdin"
).split()
_QUOTES = "\"“”„«»‹›"
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~" + _QUOTES + "‘’…–—¿¡"
_REPORT = frozenset("said says say wrote writes called calls quoted quote quotes word words term slur insult tweeted claimed sagte schrieb nannte wort dit écrit mot appelé dijo escribió palabra llamó".split())
_YOU = frozenset("you your you're u ur du dich dein ihr tu toi te vous vos usted tú ti".split())


def misspelt(term: str, edits: int) -> float:
    """What a misspelling counts of its term: the part of it that is left. At
    the edits allowed that is 3/4 at least, so one that is addressed is enough."""
    return 1 - edits / len(term) if edits else 1.0


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Trie:
    def __init__(self, terms):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for ch in t:
                node = node.setdefault(ch, {})
            node[""] = t


class LevenshteinAutomaton:
    """States are tuples of (letters of the word used, edits so far)."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits

    def start(self) -> tuple:
        return tuple((i, i) for i in range(min(self.edits, len(self.word)) + 1))

    def step(self, state: tuple, ch: str) -> tuple:
        best: dict[int, int] = {}
        for i, e in state:
            if e < self.edits:  # the term's letter is extra, or replaced
                if best.get(i, 9) > e + 1:
                    best[i] = e + 1
                if i < len(self.word) and best.get(i + 1, 9) > e + 1:
                    best[i + 1] = e + 1
            for k in range(self.edits - e + 1):  # k letters of the word are extra
                if i + k < len(self.word) and self.word[i + k] == ch and best.get(i + k + 1, 9) > e + k:
                    best[i + k + 1] = e + k
        return tuple(sorted(best.items()))

    def distance(self, state: tuple) -> int | None:
        """Edits when the term ends here, or None beyond the limit."""
        least = min((e + len(self.word) - i for i, e in state), default=99)
        return least if least <= self.edits else None


def intersect(word: str, trie: Trie) -> tuple[str, int] | None:
    """The nearest term within its allowance, ties by term."""
    auto = LevenshteinAutomaton(word, 2)
    best, todo = None, [(trie.root, auto.start())]
    while todo:
        node, state = todo.pop()
        for ch, then in node.items():
            if ch == "":
                d = auto.distance(state)
                if d is not None and d <= edits_allowed(then) and (best is None or (d, then) < best):
                    best = (d, then)
            elif after := auto.step(state, ch):
                todo.append((then, after))
    return best and (best[1], best[0])


@dataclass
class Lexicon:
    terms: tuple[str, ...] = TERMS
    stems: tuple[str, ...] = ()
    clean: frozenset = field(default_factory=frozenset)  # near misses that are ordinary words
    weights: dict[str, float] = field(default_factory=dict)  # of learned words and stems ("stem*"); others weigh 1

    def matcher(self) -> Matcher:
        return Matcher(self)


def _letters(word: str) -> int:
    out = 0
    for ch in word:
        out |= 1 << (ord(ch) & 63)
    return out


class Matcher:
    """word -> (term, edits) or None, through cheap necessary conditions first:
    a term cut in one part more than its edits leaves a part of it as it is, an
    edit changes the length by one and the set of letters by two at most."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.heads, self.inner, self.tails = defaultdict(list), defaultdict(list), defaultdict(list)
        for t in lexicon.terms:
            n = edits_allowed(t) + 1
            cuts = [len(t) * k // n for k in range(n + 1)]
            parts = [t[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            entry = len(t), n - 1, _letters(t), t
            self.heads[parts[0]].append(entry)
            for x in parts[1:-1]:
                self.inner[x].append(entry)
            for x in parts[1:][-1:]:
                self.tails[x].append(entry)
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        self.stems, self.longest = frozenset(lexicon.stems), max(map(len, lexicon.terms), default=0) + 2
        self.stem_sizes = sorted({len(x) for x in self.stems})
        self.least = min((n - e for v in self.inner.values() for n, e, *_ in v), default=99)
        self.tries: dict[tuple[str, ...], Trie] = {}

    def _possible(self, word: str) -> tuple[str, ...]:
        """The terms that meet the conditions."""
        found = [x for k in self.head_sizes if (x := self.heads.get(word[:k]))]
        found += [x for k in self.tail_sizes if (x := self.tails.get(word[-k:]))]
        if len(word) >= self.least:
            found += [x for part, x in self.inner.items() if part in word]
        if not found:
            return ()
        size, own = len(word), _letters(word)
        return tuple(sorted({t for x in found for n, e, m, t in x if abs(size - n) <= e and (own ^ m).bit_count() <= 2 * e}))

    def _part(self, terms: tuple[str, ...]) -> Trie:
        """The trie cut down to some of its terms."""
        if terms not in self.tries:
            if len(self.tries) > 10_000:
                self.tries.clear()
            self.tries[terms] = Trie(terms)
        return self.tries[terms]

    def weight(self, hit: tuple[str, int]) -> float:
        term, edits = hit
        own = self.lexicon.weights.get(term, 1.0)
        return own * (misspelt(term, edits) if own >= 1 or not edits else FUZZY)

    def learned(self, hit: tuple[str, int]) -> bool:
        """Whether it is evidence that weighs less than a given term."""
        return self.lexicon.weights.get(hit[0], 1.0) < 1

    def __call__(self, word: str) -> tuple[str, int] | None:
        """The weightiest of its stems and the nearest term."""
        found = [(s + "*", 0) for n in self.stem_sizes if (s := word[:n]) in self.stems]
        if 0 < len(word) <= self.longest and (terms := self._possible(word)):
            hit = intersect(word, self._part(terms))
            if hit and (not hit[1] or word not in self.lexicon.clean):
                found.append(hit)
        return max(found, key=self.weight, default=None)


def _near_copies(texts: list[str]) -> list[int]:
    """A group number for each text; near copies share it, so that a text that
    was copied often doesn't count as that many witnesses."""
    arr = pa.array(texts, pa.string())
    sig = np.zeros((len(texts), 4), np.uint64)
    for a, b in slices(arr):
        data, first, last, doc = words(arr, a, b)
        g = ngrams(word_hashes(data, first, last), 3)
        d = doc[: len(g)]
        ok = doc[2:] == d if len(g) else np.zeros(0, bool)
        g, d = g[ok], d[ok]
        if len(d):
            at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            for k in range(4):
                sig[a + d[at], k] = np.minimum.reduceat(mix(g + np.uint64(k * 0x9E3779B9)), at)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in range(4):
        seen: dict[int, int] = {}
        for i, s in enumerate(sig[:, k].tolist()):
            if s:
                parent[root(i)] = root(seen.setdefault(s, i))
    return [root(i) for i in range(len(texts))]


def _units(word: str) -> tuple[str, ...]:
    """What evidence may be counted of: the word and its stems."""
    return (word, *(word[:n] + "*" for n in range(4, min(8, len(word)) + 1)))


def _weights(bad: np.ndarray, clean: np.ndarray, n_bad: int, n_clean: int, groups: np.ndarray, least: int) -> np.ndarray:
    """Lower bound of each unit's log likelihood ratio, 0 where it tells little."""
    ratio = np.log((bad + 0.5) / (n_bad + 1)) - np.log((clean + 0.5) / (n_clean + 1)) - Z * np.sqrt(1 / (bad + 0.5) + 1 / (clean + 0.5))
    return np.where((groups >= least) & (ratio > np.log(3)), ratio, 0.0)


def _bar(evidence: np.ndarray, toxic: np.ndarray) -> float:
    """The sum of evidence that errs least between toxic and clean texts."""
    value = np.unique(np.append(evidence, 0.0))
    if len(value) < 2:
        return math.inf
    at = (value[1:] + value[:-1]) / 2
    missed = np.searchsorted(np.sort(evidence[toxic]), at)
    wrong = (~toxic).sum() - np.searchsorted(np.sort(evidence[~toxic]), at)
    errors = missed + wrong
    return float(at[np.flatnonzero(errors == errors.min())[-1]])


def learn(texts: list[str], toxic: list[int], terms: tuple[str, ...] = TERMS, least: int = 6) -> Lexicon:
    """Words and stems that at least ``least`` groups of toxic texts hold (a stem
    with eight different words under it), each with its log likelihood ratio as
    weight. Distinct words of a text add up. The sum that counts as 1 is where
    texts scored by the weights of the other ``FOLDS`` - 1 folds are told apart
    best; copies count as one text and stay in one fold."""
    group = _near_copies(texts)
    seen: set[tuple[int, int]] = set()
    kinds, labels, folds = [], [], []
    numbers: dict[str, int] = {}  # of words, so that a text is a short array
    usual: set[str] = set(ORDINARY)  # near misses among them aren't misspellings
    for text, t, g in zip(texts, toxic, group, strict=True):
        words_ = {x for w in set(text.lower().split()) if (x := w.strip(_EDGE)) and x.isalpha()}
        if not t:
            usual |= words_
        if (g, t) not in seen:
            seen.add((g, t))
            kinds.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words_), np.int32, len(words_)))
            labels.append(t)
            folds.append(int(mix(np.array([g], np.uint64))[0]) % FOLDS)
    spelt = list(numbers)
    given, held, under = set(terms), Counter(), defaultdict(set)
    for words_, t in zip(kinds, labels, strict=True):
        if t:
            units = defaultdict(set)
            for w in map(spelt.__getitem__, words_.tolist()):
                if len(w) > 3 and w not in given:
                    for u in _units(w):
                        units[u].add(w)
            held.update(units.keys())
            for u, x in units.items():
                if u[-1] == "*" and len(under[u]) < 8:
                    under[u] |= x
    names = sorted(u for u, n in held.items() if n >= least and (u[-1] != "*" or len(under[u]) >= 8))
    number = {u: i for i, u in enumerate(names)}
    label, fold, size = np.array(labels, bool), np.array(folds, np.int64), len(names)
    known: dict[int, list[int]] = {}
    count, groups = np.zeros((2, FOLDS, size)), np.zeros((FOLDS, size))
    found: list[list[list[int]]] = []
    for words_, t, f in zip(kinds, labels, folds, strict=True):
        own = []
        for i in words_.tolist():
            if (x := known.get(i)) is None:
                w = spelt[i]
                x = known[i] = [number[u] for u in _units(w) if u in number] if len(w) > 3 and w not in given else []
            if x:
                own.append(x)
        found.append(own)
        if own:
            each = np.concatenate(own).astype(np.int64)
            np.add.at(count[int(t), f], each, 1)
            if t:
                groups[f][np.unique(each)] += 1

    def fitted(use: np.ndarray) -> np.ndarray:
        inside = use[fold] if len(fold) else np.zeros(0, bool)
        return _weights(count[1, use].sum(axis=0), count[0, use].sum(axis=0), int((inside & label).sum()), int((inside & ~label).sum()), groups[use].sum(axis=0), least)

    weight = fitted(np.ones(FOLDS, bool))
    evidence = np.zeros(len(kinds))
    for f in range(FOLDS):
        others = fitted(np.arange(FOLDS) != f).tolist()
        for i in np.flatnonzero(fold == f):
            evidence[i] = sum(max(others[u] for u in x) for x in found[i])
    bar = _bar(evidence, label)
    weights = {names[i]: round(min(1.0, float(weight[i]) / bar), 6) for i in np.flatnonzero(weight)} if bar < math.inf else {}
    new = {u for u in weights if u[-1] != "*"}
    lexicon = Lexicon(tuple(sorted(new | given)), tuple(sorted(u[:-1] for u in weights if u[-1] == "*")), weights=weights)
    match = lexicon.matcher()
    return replace(lexicon, clean=frozenset(w for w in usual if (m := match(w)) and m[1]))


def fit_lexicon(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, terms: tuple[str, ...] = TERMS, max_bytes: int = MAX_BYTES) -> Lexicon:
    """Learn from at most ``max_labelled`` labelled documents and ``max_bytes`` of
    whole texts, the least hashes of their ids first."""
    picked = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled)
    held = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    order = F.xxhash64("doc_id").alias("h")
    sizes = held.groupBy(order, "doc_id").agg(F.sum(F.octet_length("text")).alias("n")).orderBy("h", "doc_id").toArrow()  # one row a labelled document
    fits = np.searchsorted(np.cumsum(np.asarray(sizes["n"], np.int64)), max_bytes, side="right")
    if fits < len(sizes):
        held = held.join(F.broadcast(docs.sparkSession.createDataFrame([(int(x),) for x in sizes["doc_id"].to_pylist()[:fits]], "doc_id long")), "doc_id", "left_semi")
    rows = held.select("text", "toxic").toArrow()  # bounded by the parameters
    order = sorted(zip(rows["text"].to_pylist(), rows["toxic"].to_pylist(), strict=True))
    del rows
    return learn([t for t, _ in order], [int(x > 0) for _, x in order], terms)


def weigh(tokens: list[str], at: int, weight: float, learned: bool) -> tuple[float, bool]:
    """A hit's score from the words around it, and whether it is quoted. Address
    doesn't raise learned evidence, whose weights are fitted without it."""
    left, right = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + 1 + WINDOW]
    me = tokens[at]
    opens = any(c in _QUOTES for c in me[:1]) or sum(c in _QUOTES for w in left for c in w) % 2 == 1
    closes = any(c in _QUOTES for c in me[1:]) or any(c in _QUOTES for w in right for c in w)
    quoted = opens and closes
    around = {w.lower().strip(_EDGE) for w in left + right}
    score = weight
    if quoted:
        score *= QUOTED
    if around & _REPORT and (quoted or not around & _YOU):
        score *= REPORTED
    if not quoted and not learned and around & _YOU:
        score *= ADDRESSED
    return score, quoted


def _scored(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch with its rows' hits, misspelled and quoted ones, and score."""
    match = lexicon.matcher()
    seen, recent = np.zeros(0, np.uint64), set()  # hashes of words that were matched
    hits: dict[int, tuple[str, int, float, bool]] = {}  # word, edits, weight, learned
    for batch in batches:
        texts = strings(batch, text)
        n, fuzzy, quoted, score = (np.zeros(len(texts), k) for k in (np.int64, np.int64, np.int64, np.float64))
        for a, b in slices(texts):
            data, first, last, doc = words(texts, a, b)
            h = word_hashes(data, first, last)
            order = np.argsort(h)
            lead = order[np.concatenate([[True], h[order[1:]] != h[order[:-1]]])] if len(h) else order
            raw = data.tobytes()
            if len(seen):
                at = np.minimum(np.searchsorted(seen, h[lead]), len(seen) - 1)
                lead = lead[seen[at] != h[lead]]
            for x, i in zip(h[lead].tolist(), lead.tolist(), strict=True):
                if x not in recent:
                    recent.add(x)
                    word = raw[first[i] : last[i]].decode(errors="replace").lower().strip(_EDGE)
                    if m := match(word):
                        hits[x] = word, m[1], match.weight(m), match.learned(m)
            if hits:
                found = np.flatnonzero(np.isin(h, np.fromiter(hits, np.uint64, len(hits))))
                for d in np.unique(doc[found]):
                    begin, end = np.searchsorted(doc, [d, d + 1])
                    own = found[np.searchsorted(found, begin) : np.searchsorted(found, end)]
                    evidence: dict[str, float] = {}  # learned words count once each
                    for i in own:
                        lo, hi = max(begin, i - WINDOW), min(end, i + WINDOW + 1)
                        tokens = [raw[first[k] : last[k]].decode(errors="replace") for k in range(lo, hi)]
                        word, edits, weight, learned = hits[int(h[i])]
                        s, q = weigh(tokens, int(i - lo), weight, learned)
                        n[a + d] += 1
                        fuzzy[a + d] += edits > 0
                        quoted[a + d] += q
                        if learned:
                            s, evidence[word] = max(0.0, s - evidence.get(word, 0.0)), max(s, evidence.get(word, 0.0))
                        score[a + d] += s
            if len(recent) > 50_000:
                more, recent = np.fromiter(recent, np.uint64, len(recent)), set()
                seen = np.sort(np.concatenate([seen, more])) if len(seen) < REMEMBERED else np.sort(np.fromiter(hits, np.uint64, len(hits)))
        score = np.round(score, 6)
        yield batch, n, fuzzy, quoted, score
    trim()


def toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", ident: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """id, hits, misspelled hits, quoted hits, score and verdict of each row."""

    def run(batches):
        for batch, n, fuzzy, quoted, score in _scored(batches, lexicon, "text"):
            yield pa.record_batch({ident: column(batch, "id"), "hits": pa.array(n), "misspelled": pa.array(fuzzy), "quoted": pa.array(quoted), "score": pa.array(score), "is_toxic": pa.array(score >= threshold)})

    kinds = [(ident, T.LongType()), *((c, T.LongType()) for c in ("hits", "misspelled", "quoted")), ("score", T.DoubleType()), ("is_toxic", T.BooleanType())]
    return docs.select(col(docs, ident).cast("long").alias("id"), col(docs, text).alias("text")).mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, whose text isn't toxic. Each row is judged
    by itself, whatever its id."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any names go through
    own = f"c{[c.lower() for c in docs.columns].index(text.lower())}"

    def run(batches):
        for batch, *_, score in _scored(batches, lexicon, own):
            yield batch.filter(pa.array(score < threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
