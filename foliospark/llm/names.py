"""Spellings of the names of people and organisations."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.links import components, pairs_within, similar_pairs
from foliospark.runtime import cut, spread

# Given names and their short forms.
NICKNAMES = {
    "james": "jim", "john": "jack", "robert": "bob", "william": "bill", "richard": "dick", "thomas": "tom", "charles": "chuck", "edward": "ted",
    "frederick": "fred", "henry": "harry", "alexander": "sandy", "anthony": "tony", "benjamin": "ben", "joseph": "joe", "leonard": "len",
    "nathaniel": "nat", "samuel": "sam", "theodore": "theo", "abigail": "abby", "dorothy": "dot", "elizabeth": "liz", "gertrude": "trudy",
    "isabella": "bella", "katherine": "kate", "margaret": "peggy", "mary": "polly", "patricia": "trish", "philippa": "pip", "susannah": "sue",
    "victoria": "vicky", "rajendra": "raju", "vijayendra": "viju", "padmavati": "paddu", "lakshmi": "lachhu", "narayanan": "nannu", "gopalan": "gopu",
    "krishna": "kittu", "subramaniam": "subbu", "balakrishna": "balu", "mohammed": "mohd",
}
# Lines of business, with abbreviations.
TRADES = {
    "timber mart": "timber tmbr timb", "paper mills": "paper ppr pap", "cement works": "cement cem cmt", "stores": "stores store strs str", "foods": "foods fds food",
    "electricals": "electricals electls elec electrical electric elect", "hardware": "hardware hdwr hardwares hw", "enterprises": "enterprises enterprise enterp entp ent entps",
    "engineering": "engineering engg eng engineers engrs", "chemicals": "chemicals chems chem chemical", "agencies": "agencies agency agy agcy agcs agys",
    "textiles": "textiles txtls tex textile text", "industries": "industries inds indus ind industry", "ceramics": "ceramics ceram cerm ceramic",
    "manufacturing": "manufacturing mfg manufacturers mfrs manuf", "traders": "traders trdrs tdrs trading trader trdg",
}
# Second words of a line of business.
TRADE_TAILS = frozenset("mart mt mills mls mill works wks work wrks".split())
# Legal forms and kinship forms of firms, and titles and roles of people.
FORMS = frozenset("private pvt p limited ltd llp lp and n co company comp bros brothers bro sons sns son inc corp the for messrs ms pte opc".split())
TITLES = frozenset("mr mrs ms miss smt shri sri shrimati dr prof kum kumari esq prop proprietor contractor sr jr capt col adv er m".split())
PLACEHOLDERS = frozenset("na nil none null unknown cash self same ditto test xxx buyer seller customer party tbd notavailable asabove sameasabove notapplicable illegible".split())

_NICK = {v: k for k, v in NICKNAMES.items()}
_TRADE = {w: t for t, ws in TRADES.items() for w in ws.split()}
_DIGITS = str.maketrans("0134567895|$", "oleasgtbgsls")
_TOKEN = re.compile(r"[^\W\d_]+")


def edits(a: str, b: str, most: int) -> int:
    """Edit distance, transpositions of neighbours counting one, within a band; ``most`` + 1 beyond it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        row = [most + 1] * (len(b) + 1)
        row[0] = i
        for j in range(lo, hi + 1):
            v = min(last[j - 1] + (x != b[j - 1]), last[j] + 1, row[j - 1] + 1)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, before[j - 2] + 1)
            row[j] = v
        if min(row[lo : hi + 1], default=0) > most:
            return most + 1
        before, last = last, row
    return min(last[len(b)], most + 1)


_KNOWN = {"given": {**{g: g for g in NICKNAMES}, **_NICK}, "trade": _TRADE, "tail": {w: w for w in TRADE_TAILS}, "form": {w: w for w in FORMS}, "title": {w: w for w in TITLES}}
_LONG = {which: [(w, frozenset(w)) for w in known if len(w) >= 5] for which, known in _KNOWN.items()}


@lru_cache(maxsize=200_000)
def _closest(word: str, which: str) -> str | None:
    """The given name or line of business that ``word`` spells, or None."""
    known = _KNOWN[which]
    if word in known:
        return known[word]
    if len(word) < (4 if which == "given" else 5):
        return None
    # An edit changes at most two of the letters that words are made of.
    letters = frozenset(word)
    best = min(((edits(word, w, 2), w) for w, own in _LONG[which] if abs(len(w) - len(word)) < 3 and len(letters ^ own) < 5), default=(9, ""))
    return known[best[1]] if best[0] <= (1 if len(best[1]) < 7 or len(word) < 6 else 2) else None


def fold(word: str) -> str:
    """``word`` with spellings of one sound made alike: ph f, th t, sh s, bh b, dh d, kh k, ck c q k, ou o, oo u, w v, y i, double letters single."""
    w = word
    for a, b in (("ph", "f"), ("th", "t"), ("sh", "s"), ("bh", "b"), ("dh", "d"), ("kh", "k"), ("ck", "k"), ("oo", "u"), ("ou", "o"), ("ee", "i"), ("c", "k"), ("q", "k"), ("w", "v"), ("y", "i")):
        w = w.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", w)


def parse_name(text: str | None) -> tuple[str, str, str, str, str] | None:
    """(kind, head, initials, first, last) of a name, or None if it names nobody.

    ``kind`` is ``person``, ``firm`` or ``other``; ``head`` the full given name, or its initial, or the line of business; ``first`` the folded own
    words before the last, ``last`` the folded last one; ``initials`` the letters that stand for words, in order.  A comma puts the words before it last.
    """
    if not text:
        return None
    t = unicodedata.normalize("NFKC", text).lower().translate(_DIGITS)
    t = re.sub(r"\b(?:s|d|w|c)\s*/\s*o\b.*$", " ", t)
    t = re.sub(r"^\W*m\s*/\s*s\b\.?|^\W*(?:for|to)\s*:", " ", t)
    t = re.sub(r"\bh\s*/\s*w\b", " hardware ", t)
    t = re.sub(r"l\s*\.\s*l\s*\.\s*p\b\.?", " llp ", re.sub(r"\(\s*p\s*\)", " ", t))
    t = re.sub(r"\(\s*prop\w*\.?\s*\)|,?\s*\b(?:contractor|prop|proprietor)\b\.?\s*$", " ", t)
    nick = [x for x in re.findall(r"[\(\"']\s*([a-z]+)\s*[\)\"']", t) if _closest(x, "given")]
    t = re.sub(r"\([^)]*\)", " ", t)
    if re.sub(r"\W", "", t) in PLACEHOLDERS:
        return None
    before, comma, after = t.partition(",")
    if comma and _TOKEN.search(after) and _TOKEN.search(before):
        left, right = _TOKEN.findall(before), _TOKEN.findall(after)
        words = left + right
        swapped = len(left)
    else:
        words, swapped = _TOKEN.findall(t), 0
    trade = None
    own: list[tuple[str, int]] = []
    for i, w in enumerate(words):
        found = _closest(w, "trade")
        if found and trade is None and (len(words) > 1):
            trade = found
        elif found and trade == found:
            pass
        else:
            own.append((w, i))
    if trade:
        # Legal forms go; single letters count as initials only before the firm's own words.
        kept = [w for w, _ in own if len(w) == 1 or not (w in TRADE_TAILS or w in FORMS or _closest(w, "tail") or _closest(w, "form"))]
        solid = [j for j, w in enumerate(kept) if len(w) > 1]
        if not solid:
            return None
        initials = "".join(w for w in kept[: solid[-1]] if len(w) == 1)[:1]
        words = [fold(kept[j]) for j in solid]
        return "firm", trade, initials, "".join(words[:-1]), words[-1]
    own = [(w, i) for w, i in own if not (w in TITLES and (len(w) > 1) or w in FORMS and len(w) > 1)]
    given, rest = (_closest(nick[0], "given") if nick else None), []
    for w, i in own:
        found = _closest(w, "given")
        if found and given is None:
            given = found
        elif found and found == given:
            continue
        else:
            rest.append((w, i))
    if swapped:
        rest = [x for x in rest if x[1] >= swapped] + [x for x in rest if x[1] < swapped]
    if given is None and len(rest) > 1:
        # A given name may have grown together with the word behind it: at the beginning of a name only, for last words begin with given names too.
        for j, (w, i) in enumerate(rest[:1]):
            hit = next((g for g in sorted([*NICKNAMES, *(x for x in _NICK if len(x) > 3)], key=len, reverse=True) if len(w) > len(g) + 2 and w.startswith(g)), None)
            if hit:
                given = _NICK.get(hit, hit)
                rest[j] = (w[len(hit) :], i)
    solid = [fold(w) for w, _ in rest if len(w) > 1]
    letters = [w for w, _ in rest if len(w) == 1]
    if not solid:
        return None
    if given:
        return "person", given, "".join(letters)[:1], "".join(solid[:-1]), solid[-1]
    # Initials before or behind all words stand for the given name; between words they don't.
    if letters and 1 in (len(rest[0][0]), len(rest[-1][0])):
        return "person", letters[0], "".join(letters[1:2]), "".join(solid[:-1]), solid[-1]
    return "other", "", "", "".join(solid[:-1]), solid[-1]


_PARSED = pa.schema([(n, pa.string()) for n in ("name", "kind", "head", "initials", "first", "last")])


def name_forms(names: DataFrame) -> DataFrame:
    """``name`` and its parts for every distinct ``name`` that names somebody."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, *p) for n in b.column(0).to_pylist() if (p := parse_name(n))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=_PARSED)

    return spread(names.select("name").where("name is not null").distinct(), "name").mapInArrow(parse, "name string, kind string, head string, initials string, first string, last string")


def allowed_edits(length: int) -> int:
    """Edits that spellings of one name of so many letters may differ by."""
    return 0 if length < 5 else 1 if length < 8 else 2 if length < 11 else 3


def link_names(entities: DataFrame) -> DataFrame:
    """``entity_id, cluster``: cards whose names mean one person or organisation share a cluster.

    Names are parsed to given name or line of business and own words, legal forms and titles aside.  Names of one head are joined by their own words, in either
    order, with a pigeonhole segment join and banded edit distance; connected names are one party.  A name that is shortened, to initials or
    without its first own word, goes to the only party of that head and last word that it fits; if several fit, it stays with its like.

    Null, empty and place-holder names give no row, nor do null ids.  A repeated id counts once, with its smallest name.  Very long names are read whole.
    Equal names collapse before the join.
    """
    cards = entities.where("entity_id is not null and entity_name is not null").groupBy(F.col("entity_id").cast("bigint").alias("entity_id")).agg(F.min("entity_name").alias("name"))
    cards = cut(cards)
    parts = ["kind", "head", "initials", "first", "last"]
    parsed = cut(name_forms(cards).withColumn("form", F.xxhash64(*parts)))
    forms = cut(parsed.groupBy("form").agg(*(F.first(c).alias(c) for c in parts)))
    block = F.concat_ws("|", "kind", "head", "initials")
    body, turned = F.concat("first", "last"), F.concat("last", "first")
    bodies = forms.select("form", block.alias("block"), body.alias("s"), F.lit(0).alias("turned"))
    both = bodies.unionByName(forms.where("first != ''").select("form", block.alias("block"), turned.alias("s"), F.lit(1).alias("turned")))
    edges = similar_pairs(bodies.select(F.col("form").alias("id"), "block", "s"), both.select(F.col("form").alias("id"), "block", "s"), allowed_edits)
    groups = cut(components(edges, forms.select(F.col("form").alias("id"))).select(F.col("id").alias("form"), "component").join(forms, "form"))
    return cards.join(parsed.select("name", "form"), "name").join(_shortened(groups), "form").select("entity_id", F.col("component").alias("cluster"))


def _shortened(groups: DataFrame) -> DataFrame:
    """``form, component`` with shortened names moved to the one party that they fit."""
    area = F.concat_ws("|", "kind", F.when(F.col("kind") == "person", F.substring("head", 1, 1)).otherwise(F.col("head")))
    whole = F.expr("first != '' and initials = '' and (kind != 'person' or length(head) > 1)")
    full = groups.where(whole)
    # One row for each last word of a party, whatever its spellings.
    targets = full.select(F.xxhash64("component", "last", "head", "first").alias("id"), area.alias("block"), F.col("last").alias("s"), "head", "first", "component").dropDuplicates(["id"])
    short = groups.where(~whole).join(full.select("component").distinct(), "component", "left_anti")
    asked = short.select(F.col("form").alias("id"), area.alias("block"), F.col("last").alias("s"))
    near = similar_pairs(asked, targets.select("id", "block", "s"), lambda n: 0 if n < 5 else 1, within=False)
    t = targets.select(F.col("id").alias("b"), F.col("head").alias("t_head"), F.col("first").alias("t_first"), F.col("component").alias("t_component"))
    fits = (
        near.join(short.select(F.col("form").alias("a"), "head", "initials", "first"), "a").join(t, "b")
        .where("head = t_head or (length(head) = 1 and startswith(t_head, head))")
        .where("initials = '' or startswith(t_first, initials)")
        .where("first = '' or levenshtein(first, t_first, 1) between 0 and 1")
    )
    only = fits.groupBy(F.col("a").alias("form")).agg(F.min("t_component").alias("t_component"), F.max("t_component").alias("other")).where("t_component = other")
    return groups.select("form", "component").join(only.select("form", "t_component"), "form", "left").select("form", F.coalesce("t_component", "component").alias("component"))


def same_names(entities: DataFrame) -> DataFrame:
    """``entity_id_a, entity_id_b`` (a < b) of all cards whose names mean the same."""
    return pairs_within(link_names(entities), "entity_id", "cluster")
