"""Postal addresses of one premises, through a gazetteer built from the addresses themselves."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.links import components, pairs_within, probes, segments, similar_pairs
from foliospark.llm.names import edits, fold
from foliospark.runtime import cut, spread

# Kinds of streets, localities and units, with their abbreviations.
STREET_TYPES = {
    "cross road": ("cross road", "x road", "cross rd", "x rd", "crs rd"), "road": ("road", "rd", "raod"), "street": ("street", "st", "str"), "lane": ("lane", "ln", "gali"),
    "marg": ("marg", "mg", "mrg"), "bazaar": ("bazaar", "bzr", "bazar", "bazzar"), "chowk": ("chowk", "chk", "chouk"), "avenue": ("avenue", "ave", "av", "avn"),
}
LOCALITY_TYPES = {
    "gunj": ("gunj",), "vihar": ("vihar",), "colony": ("colony", "col"), "layout": ("layout",), "puram": ("puram",), "nagar": ("nagar", "ngr"), "extension": ("extension", "extn"),
    "industrial area": ("industrial area", "indl area", "ind area"), "market yard": ("market yard", "mkt yd", "mkt yard", "market yd"), "ward": ("ward no", "ward", "w"),
}
UNIT_TYPES = {"shop": ("shop", "sh"), "flat": ("flat", "flt", "apt", "apartment"), "office": ("office", "ofc", "off"), "godown": ("godown", "gdn")}
PLACEHOLDERS = frozenset("na n/a nil none null unknown same sameasabove asabove ditto test xxx tbd notavailable notapplicable".split())

_words = lambda table: {w.replace(" ", ""): t for t, ws in table.items() for w in ws}
_STREET, _LOCALITY = _words(STREET_TYPES), _words(LOCALITY_TYPES)
_UNIT = {w: t for t, ws in UNIT_TYPES.items() for w in ws}
_PIN = re.compile(r"(?:\bpin\b\s*(?:code)?\s*[-:.]?\s*|-\s*)?(?<![\w/])([1-9]\d{2})\s?(\d{3})(?![\w/])")
_LAND = re.compile(r"\b(?:near|nr|opp|opposite|behind|bhd|beside|adj|next to)\b\.?\s*(?:to\s+)?(?:the\s+)?(?:[a-z0-9]+\s+[a-z0-9]+)")
_UNITS = re.compile(rf"\b({'|'.join(_UNIT)})\b[.\s]*(?:no\b)?[.\s#:]*([a-z]{{0,2}}-?\d+[a-z]?)\b")
_HOUSE = r"\d+[a-z]{0,2}(?:\s?[/-]\s?\d+[a-z]{0,2})?"
_NUMBERED = re.compile(rf"(?:\b(?:h|d|house|door|plot|bldg)\b[.\s]*(?:no\b)?|\bno\b|#)[.\s:#]*({_HOUSE})\b")
_BARE = re.compile(rf"(?<![\w/-])({_HOUSE})(?![\w/])")
_WARD = re.compile(r"\b([a-z]+)\s+(?:ward(?:\s+no)?|w)\b[.\s-]*\d+\b")
_DIGITS = str.maketrans("0134567895|$", "oleasgtbgsls")


@lru_cache(maxsize=200_000)
def _like(word: str, which: str) -> str | None:
    """The entry of a fixed table that ``word`` spells, or None."""
    table = {"street": _STREET, "locality": _LOCALITY}[which]
    if word in table:
        return table[word]
    if len(word) < 6:
        return None
    best = min(((edits(word, w, 2), w) for w in table if len(w) >= 6), default=(9, ""))
    return table[best[1]] if best[0] <= (1 if len(best[1]) < 8 else 2) else None


def _find_pin(t: str) -> re.Match | None:
    """The last postal code in ``t``.

    Of three groups of three digits the first is a house's number and the others the code, but where the address or ``pin`` opens with them.
    """
    if not (hits := list(_PIN.finditer(t))):
        return None
    m = hits[-1]
    opens = not t[: m.start()].strip(" ,") or "pin" in t[m.start() : m.start(1)]
    later = None if opens else _PIN.search(t, m.start(2))
    return later or m


def read_address(text: str | None) -> dict | None:
    """The parts of an address: ``pin``, ``unit``, ``number``, ``kind`` of street, ``parts`` and ``whole``, or None for a place-holder.

    ``parts`` are the own words of street, town and region, in order, those between commas together; the locality's own word is left out, with what marks it.  ``whole`` are
    the parts of one or two words that no kind of street stands beside.
    """
    if not text:
        return None
    t = unicodedata.normalize("NFKC", text).lower()
    if re.sub(r"[^\w/]", "", t) in PLACEHOLDERS or not re.search(r"[^\W_]{2}", t):
        return None
    t = re.sub(r"[\n\r;|,]+|\s-\s|\s-(?=\s*\d{3}\s?\d{3}\b)|^-|\s-$", " , ", t)
    t = re.sub(r"\s+", " ", t)
    pin = ""
    if m := _find_pin(t):
        pin, t = m[1] + m[2], t[: m.start()] + " , " + t[m.end() :]
    t = re.sub(r"\bpin\b\s*(?:code)?\s*[-:.]*", " ", t)
    t = _LAND.sub(" , ", t)
    units = []
    for m in _UNITS.finditer(t):
        units.append(_UNIT[m[1]] + " " + m[2].replace("-", ""))
    t = _UNITS.sub(" ; ", t)
    t = _WARD.sub(" ; ", t)
    number = ""
    m = _NUMBERED.search(t) or _BARE.search(t)
    if m:
        number = re.sub(r"\s", "", m[1]).replace("-", "/")
        t = t[: m.start()] + " ; " + t[m.end() :]
    # What is left is words; digits in them are misread letters.
    raw: list[tuple[int, str]] = []
    for part, piece in enumerate(re.split(r"[,;]", t)):
        for w in re.findall(r"[^\W_]+", piece):
            w = w if w.isdigit() else w.translate(_DIGITS)
            if not w.isdigit():
                raw.append((part, w))
    kind, words = "", []
    i = 0
    while i < len(raw):
        part, w = raw[i]
        two = w + raw[i + 1][1] if i + 1 < len(raw) and raw[i + 1][0] == part else ""
        if two and two in _LOCALITY or two and len(two) > 8 and _like(two, "locality"):
            if words and words[-1][0] == part:
                words.pop()
            i += 2
        elif two and two in _STREET:
            kind, i = _STREET[two], i + 2
            words.append((part, ""))
        elif found := _like(w, "locality"):
            # The word before a locality's mark is its own.
            if words and words[-1][0] == part and words[-1][1]:
                words.pop()
            i += 1
        elif found := _like(w, "street"):
            kind, i = found, i + 1
            words.append((part, ""))
        else:
            words.append((part, fold(w)))
            i += 1
    marked, parts = {p for p, w in words if not w}, {}
    for p, w in words:
        if w:
            parts.setdefault(p, []).append(w)
    whole = [" ".join(ws) for p, ws in parts.items() if p not in marked and len(ws) < 3]
    return {"pin": pin, "unit": "+".join(sorted(units)), "number": number, "kind": kind, "parts": [" ".join(ws) for ws in parts.values()], "whole": whole}


_READ = pa.schema([("address", pa.string()), ("pin3", pa.string()), ("unit", pa.string()), ("number", pa.string()), ("parts", pa.list_(pa.string())), ("whole", pa.list_(pa.string()))])
_PLACED = pa.schema([("address", pa.string()), ("unit", pa.string()), ("number", pa.string()), ("area", pa.string()), ("spelling", pa.string())])


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for a in b.column(0).to_pylist():
            if (p := read_address(a)) and (p["number"] or p["unit"]):
                rows.append((a, p["pin"][:3], p["unit"], p["number"], p["parts"], p["whole"]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)


def street_edits(length: int) -> int:
    """Edits that spellings of one street of so many letters may differ by."""
    return 0 if length < 5 else 1 if length < 8 else 2 if length < 12 else 3


class Gazetteer:
    """The streets of one area, for lookups of misspelt, shortened or run-together names."""

    def __init__(self, streets: list[tuple[int, str, str, str]]) -> None:
        self.bodies = {body: i for i, body, _, _ in streets}
        self.words = {i: (first, second) for i, _, first, second in streets}
        self.pieces: dict[tuple[int, int, str], list[str]] = {}
        self.seconds: dict[str, list[int]] = {}
        for i, body, _, second in streets:
            for key in segments(body, street_edits):
                self.pieces.setdefault(key, []).append(body)
            if second:
                for piece in self._near_keys(second):
                    self.seconds.setdefault(piece, []).append(i)

    @staticmethod
    def _near_keys(word: str) -> set[str]:
        return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) > 4 else {word}

    def whole(self, text: str) -> list[tuple[int, int]]:
        """(street, edits) of streets that ``text`` may spell."""
        if text in self.bodies:
            return [(self.bodies[text], 0)]
        near = {b for key in probes(text, street_edits, 3, False) for b in self.pieces.get(key, ())}
        found = [(self.bodies[b], edits(text, b, 3)) for b in near]
        return [(i, e) for i, e in found if e <= street_edits(len(text))]

    def shortened(self, initial: str, second: str) -> list[tuple[int, int]]:
        """(street, edits) of streets whose first word begins with ``initial`` and whose second is ``second``, but for an edit."""
        near = {i for key in self._near_keys(second) for i in self.seconds.get(key, ())}
        out = [(i, edits(second, self.words[i][1], 1)) for i in near if self.words[i][0].startswith(initial)]
        return [(i, e) for i, e in out if e <= (1 if len(second) > 4 else 0)]


def resolve(words: list[str], gazetteer: Gazetteer, width: int = 8) -> int | None:
    """The street that ``words`` name, by beam search over what each run of words may be: an entry whole or shortened, or no street.

    None if no entry fits or two fit equally well.
    """
    beam: list[tuple[float, int, int | None]] = [(0.0, 0, None)]
    done: dict[int, float] = {}
    while beam:
        new: dict[tuple[int, int | None], float] = {}
        for cost, at, street in beam:
            if at == len(words):
                if street is not None:
                    done[street] = min(cost, done.get(street, 99.0))
                continue
            moves = [(cost + (0.3 if len(words[at]) == 1 else 1.0), at + 1, street)]
            if street is None:
                for n in (1, 2, 3):
                    run = words[at : at + n]
                    if len(run) < n:
                        break
                    moves += [(cost + 0.4 * e + 0.1 * (n == 3), at + n, i) for i, e in gazetteer.whole("".join(run))]
                if at + 1 < len(words) and len(words[at]) <= 2:
                    moves += [(cost + 0.6 + 0.4 * e, at + 2, i) for i, e in gazetteer.shortened(words[at], words[at + 1])]
                moves += [(cost + 1.3 + 0.4 * e, at + 1, i) for i, e in gazetteer.shortened("", words[at])]
            for c, pos, i in moves:
                if c < new.get((pos, i), 99.0):
                    new[pos, i] = c
        # Hypotheses that have read more words are ahead by what skipping those would have cost.
        beam = sorted(((c, pos, i) for (pos, i), c in new.items()), key=lambda x: (x[0] - 0.8 * x[1], x[2] or 0))[:width]
    if not done:
        return None
    best = sorted(done.items(), key=lambda x: (x[1], x[0]))
    return None if len(best) > 1 and best[1][1] - best[0][1] < 1e-6 else best[0][0]


#: Postal prefixes in which a part must recur, and the least share of a prefix's addresses, to be a region's name.
REGION_PREFIXES, REGION_SHARE = 3, 0.02
#: A prefix in which a town has less than this share of what it has in another is that one misread.
MISREAD_SHARE = 0.05


def _recurring(read: DataFrame) -> DataFrame:
    """``pin3, w, n, of, most``: how many of the addresses of a postal prefix have ``w`` as a whole part, and of the prefix that has most of them."""
    known = read.where("pin3 != ''")
    counted = known.select("pin3", F.explode(F.array_distinct("whole")).alias("w")).groupBy("pin3", "w").agg(F.count("*").alias("n"))
    return counted.join(known.groupBy("pin3").agg(F.count("*").alias("of")), "pin3").join(counted.groupBy("w").agg(F.max("n").alias("most")), "w")


def regions_of(read: DataFrame) -> frozenset[str]:
    """Names of regions, abbreviated or not: whole parts that recur in several postal prefixes, where a town has one.

    A prefix counts if some part of an eighth of its addresses is at home there, so that prefixes misread make no region of a town.
    At most 50 parts of each of a thousand prefixes have the share that is asked for.
    """
    found = cut(_recurring(read).where("n > 1"))
    sound = found.where(f"n * 8 >= of and n >= {MISREAD_SHARE} * most").select("pin3").distinct()
    often = found.where(f"n >= {REGION_SHARE} * of").join(sound, "pin3")
    return frozenset(r[0] for r in often.groupBy("w").agg(F.count("*").alias("prefixes")).where(f"prefixes >= {REGION_PREFIXES}").select("w").collect())


def towns_of(read: DataFrame, regions: frozenset[str] = frozenset()) -> dict[str, str]:
    """The town of each postal prefix: the word that most often is a part of an address by itself and no region.  At most a thousand prefixes of three digits.

    The prefixes that have most of their town come first.  Prefixes that are misread ones of a town's own have none.
    """
    own = _recurring(read).where("length(w) > 4 and w not like '% %' and n * 8 >= of")
    own = own.where(~F.col("w").isin(*sorted(regions))) if regions else own
    best = own.groupBy("pin3").agg(F.max(F.struct("n", "w", "most")).alias("x")).where(f"x.n >= {MISREAD_SHARE} * x.most").select("pin3", "x.n", "x.w").collect()
    return {r["pin3"]: r["w"] for r in sorted(best, key=lambda r: (-r["n"], r["pin3"]))}


class Regions:
    """Takes the names of regions out of a part's words, misspelt ones too; a short form counts only at a part's end."""

    def __init__(self, names: frozenset[str]) -> None:
        self.names, self.long = names, sorted(n for n in names if len(n) > 5)
        self.known: dict[str, bool] = {}

    def like(self, w: str) -> bool:
        if w in self.names:
            return True
        if len(w) < 6:
            return False
        if w not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            near = min(((edits(w, n, 2), n) for n in self.long), default=(9, ""))
            self.known[w] = near[0] <= (1 if len(near[1]) < 8 else 2)
        return self.known[w]

    def without(self, part: str) -> list[str]:
        ws, out, i = part.split(" "), [], 0
        while i < len(ws):
            two = " ".join(ws[i : i + 2])
            if i + 1 < len(ws) and (two in self.names or len(two) > 11 and self.like(two)):
                i += 2
            elif self.like(ws[i]) and (len(ws[i]) > 3 or i == len(ws) - 1):
                i += 1
            else:
                out.append(ws[i])
                i += 1
        return out


def place(read: DataFrame, towns: dict[str, str], regions: frozenset[str] = frozenset()) -> DataFrame:
    """``address, unit, number, area, spelling``: the town's prefix, and the words that are left for the street."""
    by_name: dict[str, str] = {}
    for pin3, town in towns.items():
        by_name.setdefault(town, pin3)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        region = Regions(regions)

        def town_like(w: str) -> str | None:
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                near = [(edits(w, t, 2), t) for t in by_name] if len(w) > 5 else []
                best = min(near, default=(3, ""))
                known[w] = best[1] if best[0] <= 2 and sum(n[0] == best[0] for n in near) == 1 else None
            return known[w]

        for b in batches:
            rows = []
            for address, pin3, unit, number, parts in zip(*(c.to_pylist() for c in b.columns[:5])):
                own = [w for part in parts for w in region.without(part)]
                town = next((w for w in own if w in by_name), None)
                area = ""
                if town:
                    area = pin3 if towns.get(pin3) == town else by_name[town]
                elif pin3 in towns:
                    area = pin3
                    town = next((w for w in own if len(w) > 3 and edits(w, towns[pin3], 3) <= 3 and len(own) > 1), None)
                # Of two words one must be left that can be a whole street, run together.
                if not area and len(own) > 1 and (near := next(((w, t) for w in reversed(own) if (len(own) > 2 or len(own[own[0] == w]) > 8) and (t := town_like(w))), None)):
                    town, area = near[0], by_name[near[1]]
                if not area:
                    area = pin3
                if town in own:
                    own.remove(town)
                rows.append((address, unit, number, area, " ".join(own)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLACED)], schema=_PLACED)

    return read.mapInArrow(put, "address string, unit string, number string, area string, spelling string")


def build_gazetteer(spellings: DataFrame) -> DataFrame:
    """``area, street, body, first, second`` of every street, from ``area, spelling, n``: spellings of one area within a few edits are one street.

    Its identifier is its smallest spelling's hash; its own spelling is the one that most addresses have.
    """
    words = F.split("spelling", " ")
    good = spellings.where("area != '' and spelling != ''").withColumn("w", words).where((F.size("w") == 2) & (F.length(words[0]) > 2) & (F.length(words[1]) > 2) | (F.size("w") == 1) & (F.length("spelling") > 8))
    forms = good.select("area", F.concat_ws("", "w").alias("body"), F.when(F.size("w") == 2, words[0]).otherwise("").alias("first"), F.when(F.size("w") == 2, F.get(words, F.lit(1))).otherwise("").alias("second"), "n")
    forms = forms.groupBy("area", "body").agg(F.max_by("first", F.struct(F.length("first") > 0, "n", "first")).alias("first"), F.max_by("second", F.struct(F.length("first") > 0, "n", "first")).alias("second"), F.sum("n").alias("n"))
    forms = cut(forms.withColumn("id", F.xxhash64("area", "body")))
    side = forms.select("id", F.col("area").alias("block"), F.col("body").alias("s"))
    streets = components(similar_pairs(side, side, street_edits), side)
    best = F.struct(F.length("first") > 0, "n", "body", "first", "second")
    return forms.join(streets, "id").groupBy("area", F.col("component").alias("street")).agg(F.max(best).alias("x")).select("area", "street", "x.body", "x.first", "x.second")


def link_addresses(entities: DataFrame, block_rows: int = 20_000) -> DataFrame:
    """``entity_id, premises``: cards whose addresses mean one house, plot or unit share ``premises``.

    Addresses are read to number, unit, postal code and own words.  Names of towns and regions are found in the addresses themselves, by postal prefix.  Street spellings are clustered within each town into a gazetteer with street
    identifiers; every address is resolved by beam search over its town's entries, or where it names no town over the one street of its name; premises are
    street, number and unit.  Null, empty and place-holder addresses, those without any number, and null ids give no row.  A repeated id counts once, with
    its smallest address.  Very long addresses are read whole.  A town's spellings are resolved in blocks of about ``block_rows``.
    """
    cards = cut(entities.where("entity_id is not null and entity_address is not null").groupBy(F.col("entity_id").cast("bigint").alias("entity_id")).agg(F.min("entity_address").alias("address")))
    read = cut(spread(cards.select("address").distinct(), "address").mapInArrow(_read_all, "address string, pin3 string, unit string, number string, parts array<string>, whole array<string>"))
    regions = regions_of(read)
    placed = cut(place(read, towns_of(read, regions), regions))
    spellings = cut(placed.where("spelling != ''").groupBy("area", "spelling").agg(F.count("*").alias("n")))
    gazetteer = cut(build_gazetteer(spellings))
    # An area's blocks share its streets.
    blocks = spellings.where("area != ''").groupBy("area").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    asked = spellings.join(blocks, "area").select("area", F.pmod(F.xxhash64("spelling"), "blocks").cast("int").alias("block"), "spelling")
    offered = (
        gazetteer.join(blocks.toDF("area", "blocks"), "area").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.col("area").alias("g_area"), F.col("block").alias("g_block"), "street", "body", "first", "second")
    )

    def search(a: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        gaz = Gazetteer(list(zip(g["street"].tolist(), g["body"], g["first"], g["second"])))
        found = [(r, s, i) for r, s in zip(a["area"], a["spelling"]) if (i := resolve(s.split(" "), gaz)) is not None]
        areas, spellings, streets = zip(*found) if found else ((), (), ())
        return pd.DataFrame({"area": pd.Series(areas, dtype=object), "spelling": pd.Series(spellings, dtype=object), "street": np.array(streets, np.int64)})

    resolved = spread(asked, "area", "block").groupBy("area", "block").cogroup(spread(offered, "g_area", "g_block").groupBy("g_area", "g_block")).applyInPandas(search, "area string, spelling string, street bigint")
    homeless = spellings.where("area = ''").select(F.xxhash64("spelling").alias("id"), F.lit("").alias("block"), F.regexp_replace("spelling", " ", "").alias("s"), "spelling")
    near = similar_pairs(homeless, gazetteer.select(F.col("street").alias("id"), F.lit("").alias("block"), F.col("body").alias("s")), lambda n: min(2, street_edits(n)), within=False)
    alone = near.groupBy("a").agg(F.min("b").alias("street"), F.max("b").alias("other")).where("street = other")
    found = resolved.unionByName(alone.join(homeless, alone["a"] == homeless["id"]).select(F.lit("").alias("area"), "spelling", "street"))
    keyed = placed.join(found, ["area", "spelling"], "left").withColumn("street", F.coalesce("street", F.xxhash64("area", "spelling")))
    return cards.join(keyed, "address").select("entity_id", F.xxhash64("street", "number", "unit").alias("premises"))


def same_addresses(entities: DataFrame) -> DataFrame:
    """``entity_id_a, entity_id_b`` (a < b) of all cards whose addresses mean the same premises."""
    return pairs_within(link_addresses(entities), "entity_id", "premises")
