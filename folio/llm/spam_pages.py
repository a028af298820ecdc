"""Keyword-stuffed and link-list pages: a hidden Markov model over a page's lines.

Every line (or sentence of a long line) gives one symbol by what can be seen in any
script: links, tags, separators, numbers, repeated words, length, closing marks, and the
share of function words. The five-state model (prose; record, which holds references,
contents, checklists and tables; link list; tag list; menu) is fitted to the symbols of
all pages by expectation maximisation, from a given start whose weight is that of PRIOR
lines a state. The Viterbi path of the fitted model labels the lines; a
page is spam if most of its words stand in lines of the last three states.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.session import cut_lineage, spread

STATES = ("prose", "record", "link", "tag", "menu")
SPAM = ("link", "tag", "menu")
#: Share of words outside prose and records from which a page is spam, and the fewest words it must have.
SPAM_SHARE = 0.5
LEAST_WORDS = 8
#: Words that count as one observation of the model.
LINE_WORDS = 12

#: Symbols (the longest page's times pages) that go forward and backward together; a longer page goes alone.
FIT_CELLS = 200_000
#: Weight of the start, in lines a state, and rounds of the fit.
PRIOR, ROUNDS = 300.0, 8

# Closed-class words of English, German, French, Spanish, Italian and Portuguese, and characters of Chinese and Japanese.
FUNCTION_WORDS = frozenset(
    """a about above after against all also although an and any are as at be because been before below between both but by can did do does during
    each either for from had has have he her here his how i if in into is it its may more most my neither no nor not of on only or other our out over
    she should so some such than that the their them then there these they this those through to under until up was we were what when where whereas
    whether which while who whose will with within without would you your
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach
    nicht noch nur oder sich sie sind so um und unter vom von vor war waren was wenn werden wie wir wird wurde wurden zu zum zur zwischen
    au aux avec ce ces cette d dans de depuis des du elle en entre est et il ils je l la le les leur lui mais même n ne nous on ont ou où par pas
    plus pour qu que qui s sa sans se ses si son sont sous sur un une vous
    al como con contra cuando de del desde donde el ella entre es esta este fue ha hasta hay la las le lo los más me mi muy no o para pero por que se si
    sin sobre son su sus también un una uno y ya
    alla anche che ci con da dal dei del della delle di e gli ha ho i il in ma nel nella non per più quando se sono sul sulla tra
    ao aos as com da das do dos e em foi mas mais na não nas no nos o os ou pela pelo por quando são sem seu sua também um uma""".split()
) | frozenset("的是了在和有我不这那就也与及之其为于を の に は が と で も へ や か な た だ る".replace(" ", ""))

# Symbols of a line: s sentence, t title or heading, r record, u link, k keywords, h tags,
# m menu, w soup of the page's few words, l a short line, v a short line with function
# words (verse, captions), x anything else. A short line says nothing by itself: its
# chance is the same in every state, so only the lines around it label it.
SYMBOLS = "strukhmwlvx"
UNDECIDED = SYMBOLS.index("l")
# Start of the fit: how often each symbol (in the order of SYMBOLS) is expected of each state, and how a page begins and goes on.
EMIT = {
    "prose": (0.60, 0.14, 0.03, 0.005, 0.03, 0.001, 0.004, 0.004, 0.06, 0.076, 0.05),
    "record": (0.05, 0.09, 0.66, 0.01, 0.01, 0.001, 0.004, 0.004, 0.09, 0.031, 0.05),
    "link": (0.01, 0.02, 0.01, 0.68, 0.05, 0.02, 0.04, 0.05, 0.06, 0.01, 0.05),
    "tag": (0.005, 0.015, 0.01, 0.03, 0.40, 0.16, 0.04, 0.27, 0.04, 0.01, 0.02),
    "menu": (0.01, 0.03, 0.01, 0.04, 0.06, 0.02, 0.33, 0.17, 0.28, 0.01, 0.04),
}
START = (0.55, 0.15, 0.10, 0.10, 0.10)
STAY = 0.8

_WORD = re.compile(r"[^\W_]+")
_URL = re.compile(r"(?:https?://|www\.)\S+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])")
_DENSE = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_RECORD = re.compile(r"\s*(?:[\[(]?\d{1,4}[\])]?[.):]?\s+\S|.*\((?:1[5-9]|20)\d\d[a-z]?\)|.*\.{4,}\s*\d+\s*$)", re.S)
_TAG = re.compile(r"(?:^|\s)(?:#|tag:)\w[\w-]*")
_MENU = re.compile(r"\s(?:\||»|›|>|•|·|->)\s")
_SEPARATOR = re.compile(r"[,;|•·/»]|\s[-–]\s")
_CLOSING = (".", "!", "?", "。", "！", "？")
_NUMBER = re.compile(r"(?<!\w)[-+$€£]?\d[\d.,]*%?(?!\w)")


def words_of(text: str, dense: bool = True) -> list[str]:
    """Lower-case words; of scripts written without blanks (dense false: there are none) each character is one."""
    words = _WORD.findall(text.lower())
    if not dense or not _DENSE.search(text):
        return words
    out: list[str] = []
    for w in words:
        if not _DENSE.search(w):
            out.append(w)
            continue
        run = ""
        for c in w:
            if _DENSE.match(c):
                out += [run, c] if run else [c]
                run = ""
            else:
                run += c
        if run:
            out.append(run)
    return out


def content_of(words: list[str], dense: bool = True) -> list[str]:
    """Words that carry a topic; of neighbouring single characters of a dense script the pairs."""
    content = [w for w in words if w not in FUNCTION_WORDS and not w.isdigit()]
    if not dense or not any(len(w) == 1 and _DENSE.match(w) for w in content):
        return content
    pairs = [a + b for a, b in zip(words, words[1:]) if _DENSE.match(a) and _DENSE.match(b) and a not in FUNCTION_WORDS and b not in FUNCTION_WORDS]
    return [w for w in content if not _DENSE.match(w)] + pairs


def line_symbol(line: str, counts: Counter, total: int, dense: bool = True) -> tuple[str, int]:
    """The symbol of one line and its number of words; counts: the page's content words. '' for a line without words."""
    words = words_of(line, dense)
    n = len(words)
    if not n:
        return "", 0
    links = _URL.findall(line)
    rest = _URL.sub(" ", line) if links else line
    own = words_of(rest, dense) if links else words
    function = sum(w in FUNCTION_WORDS for w in own)
    if links and not _RECORD.match(rest) and (len(own) < 6 or not function or len(links) > 1 and len(own) < 10 * len(links)):
        return "u", n
    tags = len(_TAG.findall(rest))
    if tags >= 2 and 3 * tags >= len(own) or tags and tags >= 0.5 * len(own):
        return "h", n
    content = content_of(own, dense)
    # How much of the line is made of words that the page repeats again and again.
    often = max(4, 0.02 * total)
    repeated = sum(counts[w] >= often for w in content) / len(content) if content else 0.0
    strong = sum(counts[w] >= max(4, 0.045 * total) for w in content) / len(content) if content else 0.0
    unit = content if dense and content and len(content[0]) == 2 else own
    varied = len(set(unit)) / len(unit) if unit else 1.0
    numbers = len(_NUMBER.findall(rest))
    ended = rest.rstrip()[-1:] in _CLOSING
    if repeated < 0.5 and _RECORD.match(rest) or numbers >= 2 and 2 * numbers >= n - numbers and repeated < 0.7 and "|" not in rest:
        return "r", n
    separators = len(_SEPARATOR.findall(rest))
    if _MENU.search(rest) and function <= 0.34 * n and (n <= 20 or 4 * separators >= n):
        return "m", n
    if n > 15 and varied < 0.5 and function < 0.3 * n or strong >= 0.6 and (varied < 0.8 or n <= 8) or repeated >= 0.6 and (function < 0.1 * n or n <= 8 and not ended):
        return "w", n
    if separators >= 2 and 5 * (separators + 1) >= n and (function < 0.2 * n or varied < 0.65):
        return "k", n
    if len(own) >= 6 and function >= 0.12 * len(own):
        return "s", n
    if n <= 7 and not ended:
        return "v" if function and n >= 3 else "l", n
    if n <= 16 and line[:1].isupper():
        return "t", n
    if ended and repeated < 0.4:
        return "s", n
    return "x", n


class Model(NamedTuple):
    """Logarithms of the chances of a first state, of the way from state to state and of each symbol (symbol, state)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _chances(emit: np.ndarray) -> np.ndarray:
    """Counts (symbol, state) -> chances of the symbols in each state, that of an undecided one the same in all."""
    share = emit[UNDECIDED].sum() / emit.sum()
    rest = emit.copy()
    rest[UNDECIDED] = 0
    rest *= (1 - share) / rest.sum(0, keepdims=True)
    rest[UNDECIDED] = share
    return rest


def first_model() -> Model:
    k = len(STATES)
    return Model(np.log(START), np.log(np.where(np.eye(k, dtype=bool), STAY, (1 - STAY) / (k - 1))), np.log(_chances(np.array([EMIT[s] for s in STATES]).T)))


def _expected(seqs: list[str], times: np.ndarray, model: Model) -> np.ndarray:
    """Expected counts of first states, ways and symbols over pages' symbols (not empty, by length), in one row."""
    length = np.array([len(q) for q in seqs])
    n, top, k = len(seqs), int(length.max()), len(STATES)
    obs = np.zeros((n, top), dtype=np.int64)
    for i, q in enumerate(seqs):
        obs[i, : len(q)] = [SYMBOLS.index(c) for c in q]
    start, move, emit = (np.exp(x) for x in model)
    alpha, scale = np.zeros((top, n, k)), np.ones((top, n))
    for t in range(top):
        at = slice(int(np.searchsorted(length, t, "right")), n)  # pages longer than t
        a = (start if t == 0 else alpha[t - 1, at] @ move) * emit[obs[at, t]]
        scale[t, at] = a.sum(1)
        alpha[t, at] = a / scale[t, at, None]
    beta = np.ones((n, k))
    n_start, n_move, n_emit = np.zeros(k), np.zeros((k, k)), np.zeros((len(SYMBOLS), k))
    for t in range(top - 1, -1, -1):
        at = slice(int(np.searchsorted(length, t, "right")), n)
        if t + 1 < top:
            on = slice(int(np.searchsorted(length, t + 1, "right")), n)
            ahead = emit[obs[on, t + 1]] * beta[on] / scale[t + 1, on, None]
            n_move = n_move + move * ((alpha[t, on] * times[on, None]).T @ ahead)
            beta[on] = ahead @ move.T
        gamma = alpha[t, at] * beta[at] * times[at, None]
        np.add.at(n_emit, obs[at, t], gamma)
        if t == 0:
            n_start = n_start + gamma.sum(0)
    return np.concatenate([n_start, n_move.ravel(), n_emit.ravel()])


def expected_counts(held: Iterable[tuple[str, int]], model: Model) -> np.ndarray:
    """_expected of pages' symbols and how often each is held, in groups of about FIT_CELLS symbols."""
    rows = sorted(((q, n) for q, n in held if q), key=lambda x: len(x[0]))
    total = np.zeros(len(STATES) * (1 + len(STATES) + len(SYMBOLS)))
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and len(rows[end][0]) * (end + 1 - at) <= FIT_CELLS:
            end += 1
        total += _expected([q for q, _ in rows[at:end]], np.array([n for _, n in rows[at:end]], dtype=float), model)
        at = end
    return total


def fit(counts: Callable[[Model], np.ndarray], rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """The model that explains best what counts counts, the start counting as prior lines a state."""
    model = begun = first_model()
    k = len(STATES)
    for _ in range(rounds):
        seen = counts(model)
        if not seen.any():
            return begun
        n_start, n_move, n_emit = seen[:k] + prior * np.exp(begun.start), seen[k : k + k * k].reshape(k, k) + prior * np.exp(begun.move), seen[k + k * k :].reshape(-1, k) + prior * np.exp(begun.emit)
        model = Model(np.log(n_start / n_start.sum()), np.log(n_move / n_move.sum(1, keepdims=True)), np.log(_chances(n_emit)))
    return model


def fit_model(pages: list[str], rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """The model fitted to the pages' symbols; equal pages are computed once."""
    held = Counter(p for p in pages if p)
    return fit(lambda model: expected_counts(held.items(), model), rounds, prior)


def viterbi(symbols: str, times: tuple[int, ...], model: Model) -> tuple[int, ...]:
    """The most likely states of a symbol sequence; a symbol speaks for as many lines in one state as its times say."""
    start, move, emit = (x.tolist() for x in model)
    states = range(len(STATES))
    score, back = [], []
    for c, k in zip(symbols, times):
        e = emit[SYMBOLS.index(c)]
        if not score:
            score = [start[j] + k * e[j] + (k - 1) * move[j][j] for j in states]
            continue
        best = [max(states, key=lambda i, j=j: score[i] + move[i][j]) for j in states]
        score = [score[b] + move[b][j] + k * e[j] + (k - 1) * move[j][j] for j, b in enumerate(best)]
        back.append(best)
    at = max(states, key=score.__getitem__)
    path = [at]
    for best in reversed(back):
        at = best[at]
        path.append(at)
    return tuple(reversed(path))


def page_units(text: str) -> list[str]:
    """A page's lines, long ones cut into sentences."""
    units = []
    for line in text.splitlines():
        if len(line) > 300:
            units += _SENTENCE_END.split(line)
        else:
            units.append(line)
    return units


def page_symbols(text: str) -> list[tuple[str, int]]:
    """Symbol and number of words of each line with words."""
    dense = bool(_DENSE.search(text))
    content = Counter(content_of(words_of(_URL.sub(" ", text), dense), dense))
    total = sum(content.values())
    return [x for x in (line_symbol(u, content, total, dense) for u in page_units(text)) if x[1]]


def label_page(text: str, model: Model, cache: dict | None = None) -> dict[str, int]:
    """Number of words of a page in lines of each label; a long line speaks as often as it has LINE_WORDS words."""
    seen = page_symbols(text)
    return label_symbols("".join(s for s, _ in seen), [n for _, n in seen], model, cache)


def label_symbols(symbols: str, counts: list[int], model: Model, cache: dict | None = None) -> dict[str, int]:
    """label_page from the symbols and numbers of words of the page's lines."""
    words = dict.fromkeys(STATES, 0)
    if symbols:
        times = tuple(1 + n // LINE_WORDS for n in counts)
        path = cache.get((symbols, times)) if cache is not None else None
        if path is None:
            path = viterbi(symbols, times, model)
            if cache is not None and len(cache) < 200_000 and len(symbols) < 100:
                cache[symbols, times] = path
        for n, state in zip(counts, path):
            words[STATES[state]] += n
    return words


def _symbol_batches(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [page_symbols(t or "") for t in batch.column("_text").to_pylist()]
            symbols, counts = pa.array(["".join(s for s, _ in x) for x in seen], pa.string()), pa.array([[n for _, n in x] for x in seen], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), symbols, counts], names=[*keys, "_symbols", "_counts"])

    return run


def _count_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(expected_counts(zip(b.column("_symbols").to_pylist(), b.column("n").to_pylist()), model) for b in batches)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "x"])

    return run


def fit_pages(pages: DataFrame) -> Model:
    """The model fitted to the symbols (_symbols) of all pages; equal ones are computed once, and each round's counts are added up where they stand."""
    held = cut_lineage(pages.filter("_symbols <> ''").groupBy("_symbols").agg(F.count(F.lit(1)).alias("n")))

    def counts(model: Model) -> np.ndarray:
        total = np.zeros(len(STATES) * (1 + len(STATES) + len(SYMBOLS)))
        for r in held.mapInArrow(_count_batches(model), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            total[r.at] = r.x
        return total

    return fit(counts)


def _label_batches(keys: list[str], model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            found = [label_symbols(s, n, model, cache) for s, n in zip(batch.column("_symbols").to_pylist(), batch.column("_counts").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([w[s] for w in found], pa.int32()) for s in STATES)], names=[*keys, *(f"{s}_words" for s in STATES)])

    return run


def label_pages(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Pages -> (keys, words by label, is_spam), one row a page and repeats kept.

    Null, empty and blank texts have no words and are no spam; nulls among the keys are
    kept; no rows give no rows; other columns are left out.
    """
    src = pages.select(*keys, F.col(text).alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1], *(T.StructField(f"{s}_words", T.IntegerType()) for s in STATES)])
    total = sum((F.col(f"{s}_words") for s in STATES), F.lit(0))
    spam = sum((F.col(f"{s}_words") for s in SPAM), F.lit(0))
    # Texts are read once; symbols and numbers of words are a few bytes a line.
    read = T.StructType([*src.schema.fields[:-1], T.StructField("_symbols", T.StringType()), T.StructField("_counts", T.ArrayType(T.IntegerType()))])
    lines = cut_lineage(spread(src).mapInArrow(_symbol_batches(keys), read))
    return lines.mapInArrow(_label_batches(keys, fit_pages(lines)), schema).withColumn("is_spam", (total >= LEAST_WORDS) & (spam > F.lit(SPAM_SHARE) * total))
