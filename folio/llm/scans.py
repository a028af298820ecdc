"""Repair of text from scanned pages.

Two passes over the texts. The first counts, over all texts, words and the signatures of
lines that could be running headers, apart for lines at page edges (they break a sentence
that goes on around them) and for lines elsewhere. Signatures are fuzzy: digits are left
out; one word may differ; or only the shape of the words counts. A signature is repeated
if it stands at LEAST page edges and mostly at page edges. The second pass removes lines
whose signature is repeated and rising sequences of page numbers, joins divided words as
the vocabulary decides, and reads misread characters as words that are far more frequent.

No threshold depends on the size of the corpus. What the second pass looks up is
broadcast while it is small (BROADCAST entries) and joined to the texts beyond that,
with the same result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import ChainMap, Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import cut_lineage, spread

#: A word, or a line's signature at page edges, must occur so often to be known, or repeated.
LEAST = 3
#: A known word is still read as another one that is so many times as frequent.
RATIO = 40
#: Share of a signature's lines that must be at page edges.
EDGE_SHARE = 0.35
#: Words and signatures that are looked up in a broadcast; more are joined.
BROADCAST = 500_000
#: Lines of wrapped text are at most this long.
WRAPPED = 130
KINDS = ("hyphen", "characters", "header", "page_number")

# Marks that divide words at a line end.
MARKS = "-­‐‑¬="
# What a scanner reads, and the letters that stood there.
MISREAD = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("¢", "c"), ("|", "l"), ("!", "i"), ("!", "l"), ("@", "a"), ("$", "s"), ("€", "e"),
    ("I", "l"), ("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("ii", "u"), ("li", "h"),
    ("cl", "d"), ("d", "cl"), ("vv", "w"), ("c", "e"), ("o", "a"), ("f", "t"),
)
_CONJUNCTIONS = frozenset("and or to nor und oder bis et ou y o e in the of as".split())
_SIGNS = frozenset("0156890¢|!@$€ßﬀﬁﬂﬃﬄ")
# Headings of sections, which are repeated but belong to the text.
HEADINGS = frozenset("introduction background methods method results discussion conclusion conclusions references bibliography acknowledgements acknowledgments appendix abstract data".split()) | {"related work", "materials and methods", "results and discussion", "study area"}

_PAGE = re.compile(r"(?:\d{1,4}|[-–—·•]\s*\d{1,4}\s*[-–—·•]|\[\d{1,4}\]|\d{1,4}\s*/\s*\d{1,4}|(?:page|p\.|pp\.|seite|s\.)\s*\d{1,4}(?:\s+(?:of|von|/)\s+\d{1,4})?|[ivxlc]{1,7}|\|\s*\d{1,4}\s*\|?)", re.I)
_ROMAN = re.compile(r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_EDGE_PAGE = re.compile(r"^(?:\d{1,4}|[ivxlc]{1,7})\s{3,}(?=\S)|(?<=\S)\s{3,}(?:\d{1,4}|[ivxlc]{1,7})$")
_NUMBERED = re.compile(r"(?:\d{1,2}(?:\.\d{1,2})*\.?|[IVX]+\.)\s[A-ZÀ-Þ][^.!?]{0,60}")
_FORMULA = re.compile(r"\(\s*\d{1,3}[a-z]?\s*\)|.*\s{2,}\(\d{1,3}\)")
_TABLE = re.compile(r"\S+(?:[ ]\S+)*(?:\s{2,}|\t)\S+(?:[ ]\S+)*(?:(?:\s{2,}|\t)\S+)+")
_ITEM = re.compile(r"[*•‣◦–]\s+\S|\[?\(?\d{1,3}[\]).]\s+\S")
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_GAP = re.compile(r"\s{3,}")
_ODD_SHAPE = re.compile(r"[^AW9# .?!;]|\.\.\.$")
_PLAIN = re.compile(r"(?<![^\s(\"'“‘-])[^\W\d_]{2,}(?![^\s.,;:!?)\"'”’-])")
_COMPOUND = re.compile(r"(?<![^\s(\"'“‘])[a-zß-öø-ÿ]{2,}-[a-zß-öø-ÿ]{2,}(?![^\s.,;:!?)\"'”’])")
_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_TOKEN = re.compile(r"[^\s.,;:()\[\]\"'“”‘’?/%–—=¬­‐‑*•·_+<>{}#&~-]+")


class Evidence(NamedTuple):
    """What the second pass knows of the corpus: counts of known words, repeated signatures, beginnings and ends of words."""

    words: dict[str, int]
    lines: frozenset[str]
    begins: frozenset[str]
    ends: frozenset[str]


def page_number(line: str) -> int | None:
    """The number of a line that is a page number alone, in one of its usual dresses."""
    if not _PAGE.fullmatch(line):
        return None
    if digits := re.search(r"\d+", line):
        return int(digits.group())
    if line.islower() and line.isalpha() and _ROMAN.fullmatch(line):
        values = [_ROMAN_VALUES[c] for c in line]
        return sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0]))
    return None


def edge_number(line: str) -> int | None:
    """The page number at the side of a running header, behind a gap."""
    m = _EDGE_PAGE.search(line)
    return page_number(m.group().strip()) if m else None


def signatures(line: str) -> list[str]:
    """A line's fuzzy forms: 0 without digits, 1 with one word left open, 2 the shape of its words."""
    core, paged = _EDGE_PAGE.subn("", line)
    words = _GAP.sub(" | ", re.sub(r"\d+", "9", core)).split()
    if not words:
        return []
    out = []
    if len(words) > 1:
        low = [w.lower() for w in words]
        out.append("0" + " ".join(low))
        if len(low) <= 10:
            out += ["1" + " ".join([*low[:i], "*", *low[i + 1 :]]) for i in range(len(low)) if len(low) > 2 or low[1 - i].isalpha()]
    shape: list[str] = []
    capitals = core == core.upper()
    for w in words:
        kind = "9" if "9" in w else w if not _LETTER.search(w) else "A" if capitals else "W"
        last = shape[-1] if shape else ""
        if kind in "AW" and not w[-1].isalnum() and w[-1] not in ",:":
            kind += w[-1]
        if last == kind[:1] and kind[:1] in "AW":
            shape[-1] = kind
        elif last != kind:
            shape.append(kind)
    if len(words) > 1:
        out.append("2" + " ".join(shape))
    if paged:
        out.append("2# " + " ".join(shape))
    return out


def _is_heading(line: str) -> bool:
    return line.lower().strip(" .:") in HEADINGS or bool(_NUMBERED.fullmatch(line) and line[-1] not in ",;:" and len(line.split()) <= 8)


class Page:
    """One text's lines with what each of them is: b body, n page number, h header, k kept apart, i list item, e empty."""

    def __init__(self, text: str):
        self.lines = [x.rstrip("\r").strip(" \t\f ") for x in text.split("\n")]
        self.kind = []
        for line in self.lines:
            if not line:
                self.kind.append("e")
            elif len(line) > WRAPPED:
                self.kind.append("i" if _ITEM.match(line) else "b")
            elif page_number(line) is not None:
                self.kind.append("n")
            elif _FORMULA.fullmatch(line) or _TABLE.fullmatch(line) and not _EDGE_PAGE.search(line) or _is_heading(line):
                self.kind.append("k")
            elif _ITEM.match(line):
                self.kind.append("i")
            else:
                self.kind.append("b")
        # A column of numbers is a table's, not a row of pages.
        run = 0
        for i in range(len(self.kind) + 1):
            if i < len(self.kind) and self.kind[i] == "n":
                run += 1
            else:
                if run > 2:
                    self.kind[i - run : i] = ["k"] * run
                run = 0
        self.measure()

    def measure(self) -> None:
        """The width of the text, and whether it is wrapped at all."""
        body = sorted(len(x) for x, k in zip(self.lines, self.kind) if k in "bi")
        self.wrapped = bool(body) and body[-1] <= WRAPPED
        self.longest, self.second = (body[-1] if body else 0), (body[-2] if len(body) > 1 else 0)
        # A header may be longer than the text is wide.
        self.width = self.second if len(body) > 4 else self.longest

    def candidates(self) -> Iterator[tuple[int, int]]:
        """Lines that could be running headers, with their place: 3 in the middle of a sentence, 2 there but
        as long as any line, 1 at the border of the text or beside a page number, 0 elsewhere, -1 elsewhere and as long as any."""
        filled = [i for i, k in enumerate(self.kind) if k != "e"]
        body = [i for i in filled if self.kind[i] in "bi"]
        at = {i: n for n, i in enumerate(body)}
        for n, i in enumerate(filled):
            line = self.lines[i]
            if self.kind[i] != "b" or len(line) > 110 or line[0].islower() and edge_number(line) is None or line[-1] in MARKS or not _WORD.search(line):
                continue
            m = at[i]
            following = self.lines[body[m + 1]].split(" ", 1)[0] if m + 1 < len(body) else ""
            odd = len(line) + len(following) + 1 < self.width - 1 or len(line) > self.width or self.longest == len(line) > self.second
            before = next((self.lines[j] for j in reversed(body[max(0, m - 2) : m]) if self.lines[j][0].islower() or len(self.lines[j]) >= self.width - 12), self.lines[body[m - 1]] if m else "")
            after = next((self.lines[j] for j in body[m + 1 : m + 3] if self.lines[j][0].islower() or len(self.lines[j]) >= self.width - 12), "")
            if before and after and before[-1] not in ".!?:;\"”" and after[0].islower():
                yield i, 3 if odd else 2
            elif n in (0, len(filled) - 1) or any(0 <= j < len(filled) and self.kind[filled[j]] == "n" for j in (n - 1, n + 1)):
                yield i, 1
            else:
                yield i, 0 if odd else -1

    def mark(self, lines: frozenset[str]) -> None:
        """Calls headers what is repeated at page edges, and page numbers what rises or stands at one."""
        for i, place in list(self.candidates()):
            own = signatures(self.lines[i])
            found = {s[0] for s in own if s in lines}
            if found and (place >= 1 or "0" in found or "1" in found or self.wrapped and any(s[0] == "2" and s in lines and (_ODD_SHAPE.search(s) or s[-1] == "A" and self.lines[i].count(" ") > 2) for s in own)):
                self.kind[i] = "h"
        numbers = [(i, page_number(self.lines[i]) if k == "n" else edge_number(self.lines[i])) for i, k in enumerate(self.kind) if k in "nh"]
        numbers = [(i, v) for i, v in numbers if v is not None]
        rising = _longest_rise([v for _, v in numbers])
        inside = set(rising)
        self.paged = False
        for n, (i, _) in enumerate(numbers):
            # Beside a sequence, a number out of it is the text's own.
            if len(rising) > 1 and n not in inside or len(rising) <= 1 and self.kind[i] == "n" and "#" + re.sub(r"\d+|[ivxlc]+$", "9", self.lines[i]).lower() not in lines:
                if self.kind[i] == "n":
                    self.kind[i] = "k"
            elif self.kind[i] == "h":
                self.paged = True
        self.measure()

    def near(self, i: int, step: int) -> int | None:
        """The next line of the text itself before or after line i."""
        i += step
        while 0 <= i < len(self.lines) and self.kind[i] not in "bi":
            i += step
        return i if 0 <= i < len(self.lines) else None


def _longest_rise(values: list[int]) -> list[int]:
    """Places of a longest strictly rising sequence."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, v in enumerate(values):
        k = bisect_left(tails, v)
        before.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            ends.append(n)
        else:
            tails[k], ends[k] = v, n
    out = []
    at = ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def divided(line: str) -> str | None:
    """The beginning of a word at the end of a line with a mark behind it, or None."""
    tail = line[-60:].rstrip()
    if len(tail) < 2 or tail[-1] not in MARKS or not (tail[-2].isalnum() or tail[-2] in _SIGNS):
        return None
    word = tail[:-1].split()[-1]
    return re.sub(r"^.*[^\w¢|!@$€]", "", word[:-1]) + word[-1] if "-" not in word else word


def variants(token: str) -> list[str]:
    """What a token may have been before it was misread; tokens of over 60 characters are no words."""
    low = token.lower()
    letters = sum(c.isalpha() for c in token)
    if letters < 2 or not 4 <= len(token) <= 60 or token.isupper() or not (token[1:].islower() or not token.isalpha() or "I" in token[1:]):
        return []
    out = []
    for seen, meant in MISREAD:
        hay = token if seen in token else low if seen in low else None
        if hay is None:
            continue
        tries = [hay.replace(seen, meant)]
        at = hay.find(seen)
        while at >= 0:
            tries.append(hay[:at] + meant + hay[at + len(seen) :])
            at = hay.find(seen, at + 1)
        for x in tries:
            if len(x) > 3:
                if token[:1] == "I" and seen == "I":
                    x = x.lower()
                elif token[:1].isupper() and token[:1] != "I":
                    x = x[:1].upper() + x[1:]
                out.append(x)
    if set(token) & _SIGNS and letters >= 3:
        # Two kinds of slips in one word.
        half = [token.replace(a, b) for a, b in MISREAD if a in token]
        out += [x for h in half for a, b in MISREAD if a in h and len(x := h.replace(a, b)) > 3]
    return out


def reread(token: str, words: dict[str, int], cache: dict[str, str | None]) -> str | None:
    """The word a misread token stands for, or None: the first known one, RATIO times as frequent if the token itself is known."""
    if token in cache:
        return cache[token]
    least = max(LEAST, RATIO * words.get(token.lower(), 0))
    out = next((x for x in variants(token) if words.get(x.lower(), 0) >= least), None)
    if len(cache) < 500_000:
        cache[token] = out
    return out


def joins(left: str, right: str, known: Evidence) -> str | None:
    """How the vocabulary joins a word that left begins at a line end: word, compound or None if right isn't its rest.

    word: the whole is known, or has the beginning and end of known words; compound: known
    with its hyphen, or of two known words.
    """
    if not (right[0].islower() or not right[0].isalpha() and any(c.isalpha() for c in right)) or not any(c.isalpha() for c in left):
        return None
    part, rest = left.rsplit("-", 1)[-1].lower(), right.lower()
    words = known.words
    if words.get(part + rest, 0) >= LEAST or words.get(left.rsplit("-", 1)[-1] + right, 0) >= LEAST:
        return "word"
    if words.get(f"{part}-{rest}", 0) >= LEAST:
        return "compound"
    if rest in _CONJUNCTIONS or left.isupper() and len(left) > 5:
        return None
    if words.get(part, 0) >= LEAST and words.get(rest, 0) >= LEAST:
        return "compound"
    if (part + rest)[:2] in known.begins and (part + rest)[-2:] in known.ends:
        return "word"
    return "word" if any(words.get(x.lower(), 0) >= LEAST for x in variants(part + rest)) else None


def repair_text(text: str, known: Evidence, cache: dict[str, str | None]) -> tuple[str, list[str]]:
    """A text's paragraphs, one a line pair apart, and the kinds of noise that were in it."""
    found = set()
    if "\n" in text:
        page = Page(text)
        page.mark(known.lines)
        lines, kind = page.lines, page.kind
        if "h" in kind:
            found.add("header")
        if "n" in kind or page.paged:
            found.add("page_number")
        out: list[str] = []
        empty, torn = False, False
        current: list[str] = []
        held: list[str] = []

        def close() -> None:
            if current:
                out.append("".join(current))
                current.clear()
            out.extend(held)
            held.clear()

        for i, (line, k) in enumerate(zip(lines, kind)):
            if k == "e":
                empty = True
                continue
            if k in "hn":
                torn = True
                continue
            if k == "k":
                if current and (divided(current[-1]) or current[-1][-1] not in ".!?:;"):
                    held.append(line)  # stands inside a sentence: it follows behind it
                else:
                    close()
                    out.append(line)
                empty = torn = False
                continue
            if current:
                left = divided(current[-1])
                r = left and _TOKEN.match(line)
                if left and r and k == "b" and (how := joins(left, r.group(), known)):
                    found.add("hyphen")
                    current[-1] = current[-1].rstrip()[:-1] + ("-" if how == "compound" else "")
                    current.append(line)
                    empty = torn = False
                    continue
                tail = current[-1]
                ended = tail[-1] in ".!?:" or tail[-1] in "\"”)" and tail[-2:-1] in ".!?"
                last = lines[page.near(i, -1)] if page.near(i, -1) is not None else ""
                short = len(last) + 1 + len(line.split(" ", 1)[0]) < page.width - 1
                fresh = k == "i" or not page.wrapped or (empty and not (torn and not ended)) or (ended and short and not line[0].islower())
                if fresh:
                    close()
                    current.append(line)
                else:
                    current.append(" " + line)
            else:
                current.append(line)
            empty = torn = False
        close()
        text = "\n\n".join(out)
    reading: dict[str, str] = {}
    for token in set(_TOKEN.findall(text)):
        if token.isdigit():
            continue
        better = reread(token, known.words, cache)
        if better and better != token:
            reading[token] = better
    if reading:
        found.add("characters")
        text = _TOKEN.sub(lambda m: reading.get(m.group(), m.group()), text)
    return text, [k for k in KINDS if k in found]


def count_text(text: str, edges: Counter, others: Counter) -> None:
    """Counts a text's words and its lines' signatures at page edges and elsewhere."""

    if "\n" in text:
        page = Page(text)
        if len(page.lines) > 2:
            body = [i for i, k in enumerate(page.kind) if k in "bi"]
            for i, place in page.candidates():
                for s in signatures(page.lines[i]):
                    if place == 3:
                        edges[s] += 1
                    elif place in (0, 1) or s[0] == "2":
                        others[s] += 1
            for i, k in enumerate(page.kind):
                if k == "n":
                    b = bisect_left(body, i)
                    inside = 0 < b < len(body) and page.lines[body[b - 1]][-1] not in ".!?:" and (page.lines[body[b]][0].islower() or b + 1 < len(body) and page.lines[body[b + 1]][0].islower())
                    (edges if inside else others)["#" + re.sub(r"\d+|[ivxlc]+$", "9", page.lines[i]).lower()] += 1
        whole, torn = [], False
        for line in page.lines:
            # Both halves of a divided word are no words.
            if torn and line:
                line = line.partition(" ")[2]
            if line:
                torn = line[-1] in MARKS
                whole.append(line.rpartition(" ")[0] if torn else line)
        text = "\n".join(whole)
    edges.update(_PLAIN.findall(text))
    if "-" in text:
        edges.update(_COMPOUND.findall(text))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges, others = Counter(), Counter()

    def rows() -> pa.RecordBatch:
        keys = [*edges, *others]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([*edges.values()] + [0] * len(others), pa.int64()), pa.array([0] * len(edges) + [*others.values()], pa.int64())], names=["key", "n", "m"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            count_text(text, edges, others)
            if len(edges) + len(others) > 300_000:
                yield rows()
                edges.clear()
                others.clear()
    yield rows()


def count_evidence(texts: DataFrame) -> DataFrame:
    """Known words and repeated signatures (they begin with 0, 1, 2 or #) of all texts: (key, n), as a written table."""
    counted = texts.select("text").filter("text <> ''").mapInArrow(_gather, "key string, n long, m long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return cut_lineage(counted.filter((F.col("n") >= LEAST) & (F.col("n") >= EDGE_SHARE * (F.col("n") + F.col("m")))).select("key", "n"))


def read_evidence(rows: list[tuple[str, int]], begins: frozenset[str] = frozenset(), ends: frozenset[str] = frozenset()) -> Evidence:
    words = {k: n for k, n in rows if k[0] not in "012#"}
    return Evidence(words, frozenset(k for k, _ in rows if k[0] in "012#"), begins or frozenset(w[:2].lower() for w in words), ends or frozenset(w[-2:].lower() for w in words))


def asked_keys(text: str, frequent: dict[str, int]) -> list[str]:
    """All keys that repair_text may look up for a text, but for words of frequent and what follows from them."""
    keys: set[str] = set()
    tokens = set(_TOKEN.findall(text))
    if "\n" in text:
        page = Page(text)
        filled = [i for i, k in enumerate(page.kind) if k != "e"]
        for i, _ in page.candidates():
            keys.update(signatures(page.lines[i]))
        for n, i in enumerate(filled):
            line = page.lines[i]
            if page.kind[i] == "n":
                keys.add("#" + re.sub(r"\d+|[ivxlc]+$", "9", line).lower())
            if left := divided(line):
                part = left.rsplit("-", 1)[-1]
                # Any line that may turn out to follow: up to the next one that can't be a header or a number.
                for j in filled[n + 1 :]:
                    if r := _TOKEN.match(page.lines[j]):
                        tokens.update((part, r.group(), part + r.group()))
                        keys.add(f"{part}-{r.group()}".lower())
                    if page.kind[j] in "bi" and page.lines[j][0].islower():
                        break
    for token in tokens:
        low = token.lower()
        if low not in frequent:
            keys.add(low)
        if frequent.get(low, 0) * RATIO <= max(frequent.values(), default=0):
            keys.update(x.lower() for x in variants(token) if x.lower() not in frequent)
    return sorted(keys)


def repair_scans(texts: DataFrame, with_text: bool = True, broadcast: int = BROADCAST) -> DataFrame:
    """Texts (src_table, row_key, text) -> (src_table, row_key, text, kinds ARRAY<STRING>).

    kinds holds hyphen, characters, header and page_number as far as they occurred.
    Null and empty texts come back as they are, without kinds; repeats stay repeats;
    null keys are kept; no rows give no rows; other columns are left out. with_text
    false leaves the text out of the result. Evidence of up to broadcast entries goes to
    every task; a larger table is joined to the keys each text asks for.
    """
    texts = spread(texts.select("src_table", "row_key", "text"))
    evidence = count_evidence(texts)
    sc = texts.sparkSession.sparkContext
    names = ["src_table", "row_key", *(["text"] if with_text else []), "kinds"]
    schema = "src_table string, row_key string, " + ("text string, " if with_text else "") + "kinds array<string>"

    def repaired(batch: pa.RecordBatch, got: list[tuple[str, list[str]]]) -> pa.RecordBatch:
        text = [pa.array([g[0] for g in got], pa.string())] if with_text else []
        return pa.RecordBatch.from_arrays([batch.column("src_table"), batch.column("row_key"), *text, pa.array([g[1] for g in got], pa.list_(pa.string()))], names=names)

    if evidence.count() <= broadcast:
        shared = sc.broadcast(read_evidence([tuple(r) for r in evidence.collect()]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, cache = shared.value, {}
            for batch in batches:
                yield repaired(batch, [repair_text(t, known, cache) if t else (t, []) for t in batch.column("text").to_pylist()])

        return texts.mapInArrow(run, schema)

    # The most frequent words are broadcast as well, so that few keys of a text are left to ask for.
    words = evidence.filter(~F.left("key", F.lit(1)).isin("0", "1", "2", "#")).select(F.col("key").alias("w"), "n")
    ends = words.select(F.explode(F.array(F.concat(F.lit("<"), F.lower(F.left("w", F.lit(2)))), F.concat(F.lit(">"), F.lower(F.right("w", F.lit(2)))))).alias("e")).distinct()
    frequent = {r.w: r.n for r in words.orderBy(F.desc("n"), "w").limit(broadcast // 4).collect()}
    borders = [r.e for r in ends.collect()]
    shared = sc.broadcast((frequent, frozenset(e[1:] for e in borders if e[0] == "<"), frozenset(e[1:] for e in borders if e[0] == ">")))
    numbered = cut_lineage(texts.withColumn("_row", F.monotonically_increasing_id()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [asked_keys(t, shared.value[0]) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(keys, pa.list_(pa.string()))], names=["_row", "keys"])

    asked = numbered.select("_row", "text").mapInArrow(ask, "_row long, keys array<string>").select("_row", F.explode("keys").alias("key"))
    answers = asked.join(evidence, "key").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("_known"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, begins, ends = shared.value
        for batch in batches:
            got = []
            for text, answer in zip(batch.column("text").to_pylist(), batch.column("_known").to_pylist()):
                own = read_evidence(answer or [], begins, ends)
                got.append(repair_text(text, own._replace(words=ChainMap(own.words, frequent)), {}) if text else (text, []))
            yield repaired(batch, got)

    return numbered.join(answers, "_row", "left").mapInArrow(look, schema)
