"""Spellings of one person's or organisation's name, linked by a metric-space join.

Names are read into parts (surname, given name, initials; or an organisation's head,
kind and field). The surnames form a metric space under the Damerau-Levenshtein
distance: each is assigned to its nearest pivot, and to every cell whose border lies
within the radius (triangle inequality), and exact radius joins run inside the cells.
Near surnames with the same given name are one person; initials and acronyms go to the
only person or organisation they fit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators.components import connected_components
from folio.session import cut_lineage

RADIUS = 1
#: Pivots: a sample by hash, of so many times the root of the number of surnames, between these bounds.
PIVOT_FACTOR, LEAST_PIVOTS, MOST_PIVOTS = 3, 64, 4096
#: A token is a usual given name from this share of all names on: at most 1 / GIVEN_SHARE tokens.
GIVEN_SHARE = 0.002
#: Distances to pivots are those of the first letters; what is longer counts as within LONG_RADIUS if within RADIUS.
_LONGEST, LONG_RADIUS = 24, RADIUS + 1

# Letters that don't decompose, and their usual plain spelling.
PLAIN = {"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
# Short forms of given names and the name they usually stand for.
NICKNAMES = dict(
    pair.split(":")
    for pair in """al:albert alex:alexander sasha:alexander sandy:alexander andy:andrew anne:anne-sophie annie:anne-sophie
    becca:rebecca becky:rebecca ben:benjamin benny:benjamin beth:elisabeth betty:elisabeth lisa:elisabeth liz:elisabeth
    bella:isabella isa:isabella bill:william billy:william will:william bob:robert rob:robert bobby:robert
    cathy:katharina kathi:katharina katja:katharina kate:katharina kat:katharina charlie:charles chuck:charles
    chris:christopher kit:christopher topher:christopher cor:cornelius neil:cornelius con:cornelius dan:daniel danny:daniel
    dave:david dick:richard rick:richard dima:dmitri mitya:dmitri dora:theodora theo:theodora nika:dominika dom:dominika
    ed:edward eddie:edward ted:edward fred:frederik freddy:frederik rik:frederik gabe:gabriel gabi:gabriel greta:margarethe
    marga:margarethe gretel:margarethe meg:margarethe jette:henriette etta:henriette hetty:henriette jim:james jimmy:james
    jack:john johnny:john jon:jonathan jonny:jonathan joe:joseph josie:josephine jo:josephine fina:josephine ken:kenneth
    kolya:nikolai niko:nikolai kolja:nikolai nick:nicholas larry:lawrence leo:leonardo luc:jean-luc matt:matthew max:maximilian
    mina:wilhelmina willa:wilhelmina minna:wilhelmina mike:michael mick:michael pat:patricia trish:patricia patty:patricia
    pete:peter phil:philip pippa:philippa rafa:raphael raf:raphael ron:ronald roz:rosalind rosa:rosalind sam:samuel
    seb:sebastian bastian:sebastian steve:stephen sue:susan tina:valentina val:valentina tom:thomas tommy:thomas tomek:tomasz
    tony:anthony uli:ulrike ulli:ulrike viv:vivian walt:walter zach:zachary""".split()
)
# Words of organisations' names and their short forms, by the kind they mean.
ORG_KINDS = {"inst": "institute", "cent": "centre", "ctr": "centre", "cons": "consortium", "univ": "university", "dept": "department", "lab": "laboratory", "soc": "society"}
_ORG = re.compile(r"(?i)\b(inst(?:itut\w*)?|cent(?:re|er)\w*|ctr|cons(?:ortium\w*)?|univ\w*|dept|department|laborator\w*|society)\b")
_SMALL = frozenset("the of for f and de la le du der die das".split())
_PARTICLES = frozenset("van von de der den del della el al da di du la le ter ten dos".split())
_TITLE = re.compile(r"(?i)(?:^|(?<=\s))(?:dr|prof|mr|mrs|ms)\.\s*|,?\s*(?:ph\.?\s?d|md|m\.d|jr|sr)\.?\s*(?=;?\s*$)")


def fold(text: str) -> str:
    """Lower case without accents; an apostrophe or mark typed for an accent is left out."""
    low = "".join(PLAIN.get(c, c) for c in text.lower())
    bare = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return re.sub(r"(?<=[a-z])['\"`´^~](?=[a-z])", "", bare)


def _near(a: str, b: str) -> bool:
    """Damerau-Levenshtein distance of at most 1."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (a[i + 1 : i + 2] == b[i : i + 1] and a[i : i + 1] == b[i + 1 : i + 2] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


def parse_name(name: str, usual: dict[str, int]) -> tuple[str, str, str, str]:
    """A name's (kind, surname key, given name, initials); kind is p, o (organisation) or '' (nothing to link).

    usual: given names of the corpus with their frequency. For organisations the given
    name is kind and field initials. Initials cover all given names, hyphened parts each.
    """
    text = re.sub(r"\s+", " ", _TITLE.sub("", name.strip().strip(";").strip())).strip(" ,;")
    plain = fold(text)
    if not re.search(r"[^\W\d_]", plain):
        return "", "", "", ""
    if _ORG.search(plain) and len(plain.split()) > 2:
        words = [w for w in re.findall(r"[^\W_]+", plain) if w not in _SMALL]
        at = next((i for i, w in enumerate(words) if _ORG.fullmatch(w)), None)
        if at is not None and len(words) > 2:
            kind = next((v for k, v in ORG_KINDS.items() if words[at].startswith(k)), words[at])
            if at == 0:  # Centre of Soil Science X
                head, field = words[-1], words[1:-1]
            else:
                head, field = "".join(words[:at]), words[at + 1 :]
            return "o", head, kind + " " + "".join(w[0] for w in field), kind[0] + "".join(w[0] for w in field)
    if "," in plain:
        left, right = (x.strip() for x in plain.split(",", 1))
    else:
        raw = text.split()
        words = plain.split()
        if len(words) < 2:
            return "p", re.sub(r"[^a-z0-9]", "", plain), "", ""
        if re.fullmatch(r"[A-ZÀ-Þ]{1,4}", raw[-1]) and not raw[0].isupper():
            left, right = " ".join(words[:-1]), ".".join(words[-1]) + "."
        else:
            k = len(words) - 1
            while k > 1 and words[k - 1] in _PARTICLES:
                k -= 1
            left, right = " ".join(words[k:]), " ".join(words[:k])

    def is_given(side: str) -> bool:
        first = re.split(r"[\s.]", side)[0]
        return first in usual or first in NICKNAMES

    if is_given(left) and not is_given(right) and "." not in right:
        left, right = right, left
    tokens = [t for t in re.split(r"[\s.]+", right) if t]
    moved = [t for t in tokens if t in _PARTICLES and len(t) > 1]
    tokens = [t for t in tokens if t not in moved]
    surname = re.sub(r"[^a-z0-9]", "", "".join(moved) + left) or re.sub(r"\W", "", "".join(moved) + left)
    given = next((t for t in tokens if len(t.replace("-", "")) > 2), "")
    if given and "-" in given and all(len(x) == 1 for x in given.split("-")):
        given = ""
    if given:
        if given not in usual and given in NICKNAMES:
            given = NICKNAMES[given]
        elif given in NICKNAMES and usual.get(NICKNAMES[given], 0) > usual[given]:
            given = NICKNAMES[given]
        elif given not in usual:
            close = [g for g in usual if _near(g, given)]
            if len(close) == 1:
                given = close[0]
                given = NICKNAMES.get(given, given) if usual.get(NICKNAMES.get(given, given), 0) > usual[given] else given
        tokens = [given if len(t.replace("-", "")) > 2 else t for t in tokens]
    initials = "".join(x[0] for t in tokens for x in t.split("-") if x)
    if given and tokens and tokens[0] != given:
        initials = "".join(x[0] for x in given.split("-")) + "".join(t[0] for t in tokens if t != given)
    return "p", surname, given, initials


def damerau(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances, a true metric, of row pairs of code arrays padded with 0."""
    n, wa, wb = len(a), a.shape[1], b.shape[1]
    big = np.int16(wa + wb)
    h = np.empty((wa + 2, wb + 2, n), dtype=np.int16)
    h[0, :, :] = big
    h[:, 0, :] = big
    h[1:, 1, :] = np.arange(wa + 1, dtype=np.int16)[:, None]
    h[1, 1:, :] = np.arange(wb + 1, dtype=np.int16)[:, None]
    row_of = np.zeros((wb + 1, n), dtype=np.int16)
    rows = np.arange(n)
    for i in range(1, wa + 1):
        ai = a[:, i - 1]
        col = np.zeros(n, dtype=np.int16)
        for j in range(1, wb + 1):
            same = ai == b[:, j - 1]
            best = np.minimum(np.minimum(h[i, j + 1], h[i + 1, j]) + 1, h[i, j] + ~same)
            k = row_of[j]
            at = np.flatnonzero((k > 0) & (col > 0))
            if len(at):
                ka, la_ = k[at], col[at]
                swap = h[ka, la_, rows[at]] + (i - ka - 1) + 1 + (j - la_ - 1)
                best[at] = np.minimum(best[at], swap)
            h[i + 1, j + 1] = best
            col[same] = j
            row_of[j][same] = i
    return h[la + 1, lb + 1, rows]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([min(len(w), _LONGEST) for w in words], dtype=np.int64)
    out = np.zeros((len(words), max(1, int(lengths.max(initial=1)))), dtype=np.int32)
    for i, w in enumerate(words):
        out[i, : lengths[i]] = [ord(c) for c in w[:_LONGEST]]
    return out, lengths


def _cells(pivots: list[str]):
    pc, pl = _codes(pivots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 128):
                part = f.iloc[lo : lo + 128].reset_index(drop=True)
                c, n = _codes(part["s"].tolist())
                m, p = len(part), len(pivots)
                # Padding codes of both sides differ, so rows compare only up to their lengths.
                d = damerau(np.repeat(c, p, 0), np.repeat(n, p), np.tile(np.where(pc == 0, -1, pc), (m, 1)), np.tile(pl, m)).reshape(m, p)
                near = d.min(1)
                radius = np.where(part["s"].str.len().to_numpy() >= _LONGEST, LONG_RADIUS, RADIUS)
                i, j = np.nonzero(d <= (near + 2 * radius)[:, None])
                yield pd.DataFrame({"blk": part["blk"].to_numpy()[i], "s": part["s"].to_numpy()[i], "cell": j.astype(np.int32), "d": d[i, j].astype(np.int32), "home": d.argmin(1)[i] == j})

    return run


def near_surnames(points: DataFrame, max_pivots: int = MOST_PIVOTS) -> DataFrame:
    """Distinct points (blk, s) -> all ordered pairs (blk, s, s2), s <> s2, of one block within RADIUS.

    For d(x, y) <= r and x at home in cell p, d(y, p) <= d(y, home of y) + 2r: so y is
    copied to p, and x meets it there. Cutting both of a pair to _LONGEST letters adds 1
    to their distance at most, so such names have the radius LONG_RADIUS; what meets is
    compared as a whole. With the pivots growing as the root of the number of surnames,
    so do the cells.
    """
    surnames = points.select("s").distinct()
    wanted = int(PIVOT_FACTOR * surnames.count() ** 0.5)
    pivots = [r[0] for r in surnames.orderBy(F.xxhash64("s"), "s").limit(min(max_pivots, max(LEAST_PIVOTS, wanted))).collect()]
    if not pivots:
        return points.select("blk", "s", F.col("s").alias("s2")).limit(0)
    # A number keeps adaptive execution from putting these few but costly rows into one task.
    spread_out = points.repartition(2 * points.sparkSession.sparkContext.defaultParallelism, "blk", "s")
    placed = cut_lineage(spread_out.mapInPandas(_cells(pivots), "blk string, s string, cell int, d int, home boolean"))
    home = placed.filter("home").select("blk", "cell", "s", F.col("d").alias("dx"), F.length("s").alias("lx"))
    reach = F.when(F.length("s") >= _LONGEST, LONG_RADIUS).otherwise(RADIUS)
    copy = placed.select("blk", "cell", F.col("s").alias("s2"), F.col("d").alias("dy"), F.length("s").alias("ly"), F.explode(F.sequence(F.col("d") - reach, F.col("d") + reach)).alias("dx"))
    lev = F.levenshtein("s", "s2")
    swapped = F.expr("exists(sequence(1, length(s) - 1), i -> concat(left(s, i - 1), substring(s, i + 1, 1), substring(s, i, 1), substring(s, i + 2)) = s2)")
    met = home.join(copy, ["blk", "cell", "dx"]).filter((F.col("s") != F.col("s2")) & (F.abs(F.col("lx") - F.col("ly")) <= 1))
    near = met.filter((lev <= 1) | ((F.col("lx") == F.col("ly")) & (F.col("lx") > 1) & (lev == 2) & swapped)).select("blk", "s", "s2")
    return near.unionByName(near.select("blk", F.col("s2").alias("s"), F.col("s").alias("s2"))).distinct()


def _parse_frames(usual: dict[str, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [parse_name(n, usual) for n in f["name"]]
            yield pd.DataFrame({"name": f["name"], "kind": [g[0] for g in got], "s": [g[1] for g in got], "g": [g[2] for g in got], "ini": [g[3] for g in got]})

    return run


def usual_given_names(names: DataFrame) -> dict[str, int]:
    """First words behind a comma that are frequent among the distinct names; at most 1 / GIVEN_SHARE of them."""
    spark = names.sparkSession
    given = names.select(F.regexp_extract("name", r"^[^,]*,\s*([^\s,.;]{3,})", 1).alias("g")).filter("g <> ''")
    total = given.count()
    plain = F.pandas_udf(_fold_series, "string")
    rows = given.groupBy("g").count().filter(F.col("count") >= 2).groupBy(plain("g").alias("g")).agg(F.sum("count").alias("n")).filter(F.col("n") >= max(3, GIVEN_SHARE * total)).collect()
    del spark
    return {r.g: int(r.n) for r in rows}


def _fold_series(x: pd.Series) -> pd.Series:
    return x.map(fold)


def link_names(names: DataFrame) -> DataFrame:
    """Distinct names -> (name, entity): spellings of one entity share it; names alone have their own.

    names: (name), repeats allowed. Null, empty and letterless names get no row. Entity
    is a readable key of the least spelling. Initials or an acronym that fit several
    people or organisations stay on their own.
    """
    # A number keeps adaptive execution from reading all names in one task.
    names = names.select("name").filter("name is not null").distinct().repartition(2 * names.sparkSession.sparkContext.defaultParallelism, "name")
    usual = usual_given_names(names)
    schema = "name string, kind string, s string, g string, ini string"
    parsed = cut_lineage(names.mapInPandas(_parse_frames(usual), schema).filter("kind <> '' and s <> ''"))
    # A full form has a given name (or is an organisation); the others have initials only.
    blk = F.concat("kind", F.when(F.col("kind") == "o", F.substring("g", 1, 1)).otherwise(F.substring("ini", 1, 1)))
    parsed = parsed.withColumn("blk", blk)
    near = cut_lineage(near_surnames(parsed.select("blk", "s").distinct()))

    full = parsed.filter("g <> ''").select("blk", "kind", "s", "g", "ini").distinct()
    node = lambda k, s, g: F.concat_ws("|", k, s, g)
    nodes = full.groupBy("blk", "kind", "s", "g").agg(F.max("ini").alias("long_ini")).withColumn("node", node("kind", "s", "g"))
    by_surname = nodes.join(near, ["blk", "s"]).select("node", "kind", F.col("s2").alias("s"), "g").join(nodes.select("kind", "s", "g", F.col("node").alias("other")), ["kind", "s", "g"]).select(F.col("node").alias("a"), F.col("other").alias("b"))
    mates = nodes.select("kind", "s", F.col("g").alias("g2"), F.col("node").alias("other"))
    near_given = F.pandas_udf(_near_series, "boolean")
    by_given = nodes.join(mates, ["kind", "s"]).filter("node < other and abs(length(g) - length(g2)) <= 1 and levenshtein(g, g2) <= 2").filter(near_given("g", "g2")).select(F.col("node").alias("a"), F.col("other").alias("b"))
    components = connected_components(by_surname.unionByName(by_given))
    placed = cut_lineage(nodes.join(components, "node", "left").withColumn("entity", F.coalesce("component", "node")).select("blk", "kind", "s", "g", "long_ini", "entity"))

    soft = parsed.filter("g = ''").select("blk", "s", "ini").distinct()
    # An acronym without full stops may be initials of a person or of an organisation.
    spread = soft.join(near, ["blk", "s"], "left").groupBy("blk", "s", "ini").agg(F.collect_set("s2").alias("_n"))
    candidates = spread.select("blk", "s", "ini", F.explode(F.array_union(F.array("s"), "_n")).alias("cs"))
    people = placed.select(F.col("s").alias("cs"), "kind", "g", "long_ini", "entity")
    given_initials = F.expr("array_join(transform(split(g, '-'), x -> left(x, 1)), '')")
    fits = F.when(F.col("kind") == "o", F.col("ini") == F.col("long_ini")).otherwise(F.col("ini").startswith(given_initials) & (F.col("long_ini").startswith(F.col("ini")) | (F.col("long_ini") == given_initials)))
    scored = (
        candidates.join(people, "cs")
        .filter(fits)
        .groupBy("blk", "s", "ini", "entity")
        .agg(F.max((F.col("cs") == F.col("s")).cast("int")).alias("exact"), F.max((F.col("long_ini") == F.col("ini")).cast("int")).alias("whole"))
        .withColumn("score", F.col("exact") * 2 + F.col("whole"))
    )
    top = scored.groupBy("blk", "s", "ini").agg(F.max("score").alias("best"))
    # The one entity that fits best; several that fit equally well decide nothing.
    leading = scored.join(top, ["blk", "s", "ini"]).filter("score = best").groupBy("blk", "s", "ini").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("entity"))
    chosen = leading.filter("n = 1").select("blk", "s", "ini", "entity")

    hard = parsed.filter("g <> ''").join(placed.select("kind", "s", "g", "entity"), ["kind", "s", "g"]).select("name", "entity")
    loose = parsed.filter("g = ''").join(chosen, ["blk", "s", "ini"], "left").select("name", F.coalesce("entity", F.concat_ws("|", F.lit("i"), "s", "ini")).alias("entity"))
    return hard.unionByName(loose)


def _near_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_near(x, y) for x, y in zip(a, b)], dtype=bool)


def linked_pairs(entities: DataFrame) -> DataFrame:
    """All pairs (name_a < name_b) of different spellings of one entity."""
    other = entities.select(F.col("name").alias("name_b"), "entity")
    return entities.select(F.col("name").alias("name_a"), "entity").join(other, "entity").filter("name_a < name_b").select("name_a", "name_b").distinct()
