"""Toxicity scores from a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, reporting verb, quotation mark, other
word and so on).  Sequential transducers read the symbols of a clause one after another.  From
right to left: words that only name a thing together with the next one lose their insult ("garbage
collection"), and quotations that a reporting verb follows are marked.  From left to right:
negation marks what it covers up to a comma, reported speech marks what is only quoted,
addressing decides words that are insults of somebody only ("you are a clown", not "the clown"),
wishes join hopes, targets and death, and targeting turns what is left into clause events.  The
machines of each direction are composed into one before use.  A document's score is a logistic
function of the weighted numbers of its events; a word that takes part in no event counts
nothing.

Unambiguous insults are events also without a target, as the labels have them; their weight is
learned.  Insults are learned from labelled rows (words and open stems that occur in toxic
documents significantly more often), and so are the weights of the events, drawn to stated
priors.

Defined cases: a null or empty text has no event and gets the score of the intercept; without
usable labels the lexicon is empty and the priors hold; equal texts get equal scores.  Texts
are scored whole, clause by clause.  Other columns of the documents are never looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusweave.llm.common import (
    bounded_batches,
    crc_fold,
    fit_logistic,
    labelled_sample,
    per_text,
    sigmoid,
)
from corpusweave.plans.staging import stage

#: Most labelled rows that the lexicon and the weights are learned from.
MAX_LABELLED = 20_000
#: Rows whose CRC-32 leaves this remainder are never learned from.
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7

# Fixed word lists of the grammar; labels add insults to these.
INSULTS = set(
    "idiot idiots idiotic moron morons moronic imbecile stupid dumbass fool loser losers scum "
    "worthless pathetic disgusting jerk bastard bitch asshole shithead "
    "scumbag retard vermin liar coward "
    "dummkopf trottel blödmann arschloch abschaum versager ekelhaft wertlos "
    "imbécile crétin connard salaud débile abruti "
    "estúpido imbécil tonto cabrón gilipollas inútil asqueroso".split()
)
# Words with a plain sense: insults of somebody, or where nothing speaks for the plain sense.
DOUBTFUL = set(
    "trash garbage clown clowns pig pigs freak filth crap dumb dumm ordure basura".split()
)
THREATS = set(
    "kill hurt destroy beat burn punch shoot stab murder strangle hate despise "
    "töten schlagen verbrennen hasse tuer frapper brûler déteste matar golpear quemar odio".split()
)
TARGETS = set(
    "you your yours yourself he she they him her them his their "
    "du dich dir ihr euch sie tu toi te vous tú ti usted ustedes".split()
)
COPULAS = set("are is am was were be you're bist ist seid sind es est êtes sont eres son".split())
#: Written in one word with their target.
ADDRESSES = {"you're": ("target", "copula"), "they're": ("target", "copula"), "he's": ("target", "copula"),
             "she's": ("target", "copula")}
DETERMINERS = set(
    "the a an this that these those of some any my our its into in "
    "der die das den dem ein eine einen le la les un une des el los las una".split()
)
# Words that make a thing or a degree of the word before them.
COMPOUNDS = set(
    "collection collector collectors can cans bin bins bag bags truck trucks day disposal dump heap "
    "fish nose car farm pen cheap easy simple fast luck".split()
)
NEGATIONS = set(
    "not no never isn't aren't wasn't don't won't cannot can't nobody "
    "nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco".split()
)
REPORTS = set(
    "said says wrote writes called calls claimed claims told reported quoted "
    "sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
)
HOPES = set("hope wish hoffe hoffentlich espère espero ojalá".split())
DEATHS = set("die dies dead sterben stirbst verreckst meurs crèves mueras muerto".split())
QUOTES = "\"“”„«»"
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[" + QUOTES + ",]")
_WORD = re.compile(r"[^\W\d_]+")
#: The end of a clause; a mark inside a closing quotation ends none.
_BREAK = re.compile(r"[.!?;](?![" + QUOTES + r"])|\n")

#: Scope in words of a negation, and distance at which a target counts as addressed.
SCOPE, REACH = 3, 4
#: Prior weight of each event; labels move them.
PRIORS = {
    "insult": 3.0,
    "insult+target": 4.0,
    "insult+negated": 0.5,
    "insult+reported": 0.5,
    "threat": 5.0,
    "threat+negated": 0.0,
    "threat+reported": 0.5,
}
EVENTS = tuple(PRIORS)
STEMS = range(4, 8)


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer: ``step[state, symbol]`` gives the next state and the output.

    A missing entry repeats the symbol and stays.
    """

    start: object
    step: dict

    def __call__(self, state, symbol):
        return self.step.get((state, symbol), (state, symbol))

    def then(self, after: Transducer, symbols: Iterable) -> Transducer:
        """The machine that feeds this one's output to ``after``, for the given input symbols."""
        start = (self.start, after.start)
        step, todo, seen = {}, [start], {start}
        while todo:
            state = todo.pop()
            for symbol in symbols:
                left, middle = self(state[0], symbol)
                right, out = after(state[1], middle)
                step[state, symbol] = ((left, right), out)
                if (left, right) not in seen:
                    seen.add((left, right))
                    todo.append((left, right))
        return Transducer(start, step)


MARKED = ("insult", "threat")
#: What words become, and what the machines that read from the right make of them.
SYMBOLS = (
    "insult", "doubtful", "threat", "target", "copula", "determiner", "compound", "not", "report",
    "hope", "death", "quote", "comma", "word",
)
PASSED = (*SYMBOLS, "insult+reported", "threat+reported")


def compounds() -> Transducer:
    """From the right: a doubtful word or an insult before a compounding word is a plain one."""
    step = {("open", s): ("open", s) for s in SYMBOLS} | {("bound", s): ("open", s) for s in SYMBOLS}
    for state in ("open", "bound"):
        step[state, "compound"] = ("bound", "word")
    for kind in ("insult", "doubtful"):
        step["bound", kind] = ("open", "word")
    return Transducer("open", step)


def quoted_before_report() -> Transducer:
    """From the right: marks what stands in quotation marks before a reporting verb."""
    step = {}
    for state in ("plain", "reported", "quoted"):
        step[state, "report"] = ("quoted" if state == "quoted" else "reported", "report")
        step[state, "quote"] = ("quoted" if state == "reported" else "plain", "quote")
    for kind in MARKED:
        step["quoted", kind] = ("quoted", f"{kind}+reported")
    step["quoted", "doubtful"] = ("quoted", "insult+reported")
    return Transducer("plain", step)


def negation() -> Transducer:
    """Marks an insult or threat up to ``SCOPE`` words after a negation, in the same phrase."""
    step = {}
    for left in range(SCOPE + 1):
        for symbol in PASSED:
            less = max(0, left - 1)
            step[left, symbol] = (less, symbol)
            if left and symbol in MARKED:
                step[left, symbol] = (less, f"{symbol}+negated")
            if left and symbol == "doubtful":
                step[left, symbol] = (less, "insult+negated")
        step[left, "not"] = (SCOPE, "word")
        step[left, "comma"] = (0, "comma")
    return Transducer(0, step)


def reported_speech() -> Transducer:
    """Marks what follows a reporting verb, or stands in quotation marks after one."""
    step = {}
    for state in ("plain", "reported", "quoted"):
        step[state, "report"] = ("reported", "word")
        step[state, "quote"] = ("quoted" if state == "reported" else "plain", "word")
    step["quoted", "report"] = ("quoted", "word")
    for state in ("reported", "quoted"):
        for kind in MARKED:
            step[state, kind] = (state, f"{kind}+reported")
            step[state, f"{kind}+negated"] = (state, f"{kind}+negated")
        step[state, "doubtful"] = (state, "insult+reported")
    return Transducer("plain", step)


def addressing() -> Transducer:
    """Decides doubtful words: insults right after a target, or after one and its copula; plain
    after a determiner; else insults."""
    far, step = REACH + 1, {}
    symbols = (*PASSED, *(f"{kind}+negated" for kind in MARKED))
    # Words since a target and its copula, and what stood before.
    for since in range(far + 1):
        for last in ("target", "determiner", "word"):
            for symbol in symbols:
                later, out = min(far, since + 1), symbol
                if symbol == "copula":
                    later, out = (0 if last == "target" else later), "word"
                if symbol in ("determiner", "hope", "death", "compound"):
                    out = symbol if symbol in ("hope", "death") else "word"
                if symbol == "doubtful":
                    plain = last == "determiner" and since >= REACH
                    out = "word" if plain else "insult"
                now = symbol if symbol in ("target", "determiner") else "word"
                step[(since, last), symbol] = ((later, now), out)
    return Transducer((far, "word"), step)


def wishes() -> Transducer:
    """A hope, then a target, then death within reach is a wish, which is a threat."""
    step = {}
    for stage_ in ("none", "hope", "target"):
        for left in range(REACH + 1):
            state = (stage_, left)
            aged = (stage_, left - 1) if left > 0 else ("none", 0)
            for symbol in (*PASSED, *(f"{kind}+negated" for kind in MARKED)):
                step[state, symbol] = (aged, symbol)
            step[state, "hope"] = (("hope", REACH), "word")
            step[state, "target"] = (("target", REACH) if stage_ != "none" else aged, "target")
            step[state, "death"] = (("none", 0), "wish" if stage_ == "target" else "word")
    return Transducer(("none", 0), step)


def targeting() -> Transducer:
    """Turns marked symbols into events; ``None`` is no event.

    The state holds the words since the last target and since the last open insult or threat.
    A plain insult is an event at once, and a second one when its target follows.  A wish is the
    event of a threat.
    """
    step = {}
    far = REACH + 1
    marked = [*MARKED, *(f"{kind}+{mark}" for kind in MARKED for mark in ("negated", "reported"))]
    for since in range(far + 1):
        for pending in (None, *((m, d) for m in marked for d in range(REACH + 1))):
            later = min(far, since + 1)
            aged = None if pending is None or pending[1] >= REACH else (pending[0], pending[1] + 1)
            state = (since, pending)
            step[state, "word"] = ((later, aged), None)
            step[state, "comma"] = (state, None)
            step[state, "wish"] = ((later, aged), "threat")
            found = pending and (pending[0] if pending[0].startswith("threat") else None)
            if pending and pending[0] == "insult":
                found = "insult+target"
            step[state, "target"] = ((0, None), found)
            for m in marked:
                if m.startswith("threat"):
                    # A threat needs somebody threatened: a target after it.
                    step[state, m] = ((later, (m, 0)), None)
                elif m == "insult" and since < REACH:
                    step[state, m] = ((later, None), "insult+target")
                else:
                    step[state, m] = ((later, (m, 0)), m)
    return Transducer((far, None), step)


#: The machines in the order in which they read: from the right, and then from the left.
BACKWARD = (compounds, quoted_before_report)
FORWARD = (negation, reported_speech, addressing, wishes, targeting)


@lru_cache(2)
def grammar(forward: bool) -> Transducer:
    machines, symbols = (FORWARD, PASSED) if forward else (BACKWARD, SYMBOLS)
    whole = machines[0]()
    for machine in machines[1:]:
        whole = whole.then(machine(), symbols)
    return whole


def _numbered(machine: Transducer, symbols: tuple, outputs: dict) -> tuple[int, list, list]:
    """Start, next states and outputs of a composed machine, over small numbers."""
    states = {s: i for i, s in enumerate(dict.fromkeys(s for s, _ in machine.step))}
    codes = {s: i for i, s in enumerate(symbols)}
    following = [[0] * len(symbols) for _ in states]
    out = [[None] * len(symbols) for _ in states]
    for (state, symbol), (to, said) in machine.step.items():
        following[states[state]][codes[symbol]] = states[to]
        out[states[state]][codes[symbol]] = outputs.get(said, said)
    return states[machine.start], following, out


@lru_cache(1)
def _tables() -> tuple[tuple, tuple]:
    codes = {s: i for i, s in enumerate(PASSED)}
    return _numbered(grammar(False), SYMBOLS, codes), _numbered(grammar(True), PASSED, {})


@dataclass(frozen=True)
class Lexicon:
    """Insults: whole words, and stems with an open end."""

    words: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    weights: tuple[float, ...]
    intercept: float


class _Matcher:
    def __init__(self, lexicon: Lexicon):
        self.symbol = dict.fromkeys(DETERMINERS, "determiner") | dict.fromkeys(COMPOUNDS, "compound")
        self.symbol |= dict.fromkeys(REPORTS, "report") | dict.fromkeys(NEGATIONS, "not")
        self.symbol |= dict.fromkeys(HOPES, "hope") | dict.fromkeys(DEATHS, "death")
        self.symbol |= dict.fromkeys(COPULAS, "copula") | {",": "comma"}
        self.symbol |= dict.fromkeys(TARGETS, "target") | dict.fromkeys(QUOTES, "quote")
        self.symbol |= dict.fromkeys(THREATS, "threat")
        self.symbol |= dict.fromkeys((*INSULTS, *lexicon.words), "insult")
        self.symbol |= dict.fromkeys(DOUBTFUL, "doubtful")
        self.stems = frozenset(lexicon.stems)
        self.lengths = sorted({len(s) for s in lexicon.stems})
        self.cores = ahocorasick.Automaton()
        for core in {*lexicon.words, *lexicon.stems, *INSULTS, *DOUBTFUL, *THREATS, *HOPES}:
            self.cores.add_word(core, len(core))
        self.cores.make_automaton()
        self.codes = {s: i for i, s in enumerate(SYMBOLS)}

    def symbols(self, words: list[str]) -> list[str]:
        out = []
        for word in words:
            word = word.replace("’", "'")
            found = self.symbol.get(word)
            if found is None and any(word[:n] in self.stems for n in self.lengths):
                found = "insult"
            out += ADDRESSES.get(word, (found or "word",))
        return out

    def events(self, text: str) -> Iterator[tuple[int, int, str]]:
        """``start, end, event`` for each event; start and end are those of the clause."""
        text = text.lower()
        (back, back_next, back_out), (start, following, said) = _tables()
        done = 0
        for last, size in self.cores.iter(text):
            at = last + 1 - size
            if at < done or (at and (text[at - 1].isalpha() or text[at - 1] == "_")):
                continue
            begin = done
            # The clause begins behind the last break before the word.
            cut = at
            while (cut := max(text.rfind(c, begin, cut) for c in ".!?;\n")) >= begin:
                if _BREAK.match(text, cut):
                    begin = cut + 1
                    break
            stop = _BREAK.search(text, at)
            done = stop.end() if stop else len(text)
            marked, state = [], back
            for symbol in reversed(self.symbols(_TOKEN.findall(text, begin, done))):
                code = self.codes[symbol]
                marked.append(back_out[state][code])
                state = back_next[state][code]
            state = start
            for code in reversed(marked):
                if event := said[state][code]:
                    yield begin, done, event
                state = following[state][code]


@lru_cache(4)
def _matcher(lexicon: Lexicon) -> _Matcher:
    return _Matcher(lexicon)


def clause_events(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    return list(_matcher(lexicon).events(text))


def event_features(text: str, lexicon: Lexicon) -> list[float]:
    counts = Counter(event for _, _, event in _matcher(lexicon).events(text))
    return [math.log2(1 + counts[e]) for e in EVENTS]


def _terms(text: str) -> set[str]:
    """Words, and their beginnings written with a star."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= 3}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _term_counts(sample: DataFrame) -> DataFrame:
    def count(batches):
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch["text"], batch["label"]):
                (toxic if label else clean).update(_terms(text))
            terms = [*toxic, *(t for t in clean if t not in toxic)]
            # An empty column of strings is no single Arrow array.
            if terms:
                yield pd.DataFrame(
                    {"term": terms, "toxic": [toxic[t] for t in terms], "clean": [clean[t] for t in terms]}
                )

    counted = sample.mapInPandas(count, "term string, toxic bigint, clean bigint")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _surroundings(sample: DataFrame, terms: set[str]) -> dict[str, tuple[int, int]]:
    """For each term, in how many different surroundings it is found in toxic rows, and in all.

    Surroundings are the words on both sides.
    """
    lengths = sorted({len(t) - 1 for t in terms if t.endswith("*")})

    def find(batches):
        for batch in batches:
            rows = set()
            for text, label in zip(batch["text"], batch["label"]):
                words = ["", *_WORD.findall(text.lower()), ""]
                for left, word, right in zip(words, words[1:], words[2:]):
                    for term in (word, *(word[:n] + "*" for n in lengths if len(word) > n)):
                        if term in terms:
                            rows.add((term, left, right, label))
            if rows:
                yield pd.DataFrame(sorted(rows), columns=["term", "left", "right", "label"])

    found = sample.mapInPandas(find, "term string, left string, right string, label int")
    counted = found.distinct().groupBy("term").agg(F.sum("label"), F.count("*"))
    return {r[0]: (int(r[1]), r[2]) for r in counted.collect()} if terms else {}


def _log_tail(hits: int, n: int, p: float) -> float:
    """Logarithm of the chance of ``hits`` or more successes in ``n`` trials."""
    logs = [
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        + k * math.log(p) + (n - k) * math.log1p(-p)
        for k in range(hits, min(n, hits + 60) + 1)
    ]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def learn_lexicon(sample: DataFrame, purity: float = 0.98, level: float = 0.05) -> Lexicon:
    """Terms nearly always in toxic rows, more often than chance allows over all terms tried.

    Terms are tested at a false discovery rate of ``level`` (Benjamini and Hochberg, 1995).  A
    stem stands for its words if it is pure itself and at least three words share it; otherwise
    the words stand alone.  Only terms that could pass at all reach the driver.
    """
    totals = sample.agg(F.sum("label"), F.count("*")).first()
    toxic, rows = int(totals[0] or 0), totals[1]
    if not 0 < toxic < rows:
        return Lexicon()
    base = toxic / rows
    counted = stage(_term_counts(sample).where("toxic + clean >= 3"), "toxicity-terms")
    tried = max(1, counted.count())
    pure = counted.where(F.col("toxic") >= purity * (F.col("toxic") + F.col("clean")))
    tested = sorted(
        (_log_tail(r["toxic"], r["toxic"] + r["clean"], base), r["term"])
        for r in pure.where("toxic >= 3").toLocalIterator()
    )
    last = max((k for k, (p, _) in enumerate(tested, 1) if p <= math.log(level * k / tried)), default=0)
    # Copies of one passage are one witness: what passed is tested again by its surroundings.
    least = math.log(level * max(1, last) / tried)
    seen = _surroundings(sample, {term for _, term in tested[:last]})
    passed = {t for t, (hits, n) in seen.items() if hits and _log_tail(hits, n, base) <= least}
    members = Counter()
    stems = sorted(t[:-1] for t in passed if t.endswith("*"))
    for r in pure.where("term not like '%*'").select("term").toLocalIterator() if stems else ():
        members.update(r["term"][:n] for n in STEMS if len(r["term"]) > n)
    chosen: set[str] = set()
    for stem in sorted(stems, key=len):
        if members[stem] >= 3 and not any(stem[:n] in chosen for n in STEMS):
            chosen.add(stem)
    words = {
        t for t in passed if not t.endswith("*") and not any(t[:n] in chosen for n in STEMS)
    }
    return Lexicon(tuple(sorted(words)), tuple(sorted(chosen)))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    limit: int = MAX_LABELLED,
) -> ToxicityModel:
    """Learn lexicon and event weights from at most ``limit`` labelled rows."""
    bounded_batches(docs.sparkSession)
    sample = stage(
        labelled_sample(docs, labels, label, FOLDS, HELD_OUT, limit, id_col, text_col),
        "toxicity-sample",
    )
    lexicon = learn_lexicon(sample)

    def features(batches):
        for batch in batches:
            x = [event_features(t, lexicon) for t in batch["text"]]
            yield pd.DataFrame({"x": x, "label": batch["label"]})

    # Rows with the same features are one row with a count: few reach the driver.
    rows = (
        sample.mapInPandas(features, "x array<double>, label int")
        .groupBy("x", "label")
        .count()
        .collect()
    )
    x = np.repeat(
        np.array([r["x"] for r in rows], float).reshape(-1, len(EVENTS)),
        [r["count"] for r in rows],
        axis=0,
    )
    y = np.repeat(np.array([r["label"] for r in rows], float), [r["count"] for r in rows])
    weights, intercept = fit_logistic(x, y, l2=0.1, prior=np.array(list(PRIORS.values())))
    if not len(y):
        intercept = -3.0
    return ToxicityModel(lexicon, tuple(map(float, weights)), intercept)


def toxicity_score(model: ToxicityModel):
    """A column function: the score of a text, from 0 to 1."""
    weights = np.array(model.weights)

    def score(text: bytes) -> float:
        features = event_features(text.decode("utf-8", "replace"), model.lexicon)
        return float(sigmoid(np.dot(weights, features) + model.intercept))

    return per_text(score, DoubleType())


def drop_toxic(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    bounded_batches(docs.sparkSession)
    return docs.where(toxicity_score(model)(F.col(text_col)) < threshold)


def held_out(key: Column) -> Column:
    return crc_fold(key, FOLDS) == HELD_OUT
