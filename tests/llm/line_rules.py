"""Kinds of a page's lines by hand-written rules, to hold the mixture against: prose, list entry, table row, advert or junk."""

from __future__ import annotations

import re

PROSE, LIST, TABLE, ADVERT, JUNK = range(5)

_D = r"[0-9lIOoSsZB|!]"
#: A figure, misread digits included: it holds a digit and nothing but figures' signs.
_FIGURE = re.compile(r"^[(£$]?[-+]?[0-9lIOoSsZB|!]{0,6}(?:[.,:/°'½¼¾-]?[0-9lIOoSsZB|!]+)*[°%½¼¾)\"'.,;]*$")
_LEADER = re.compile(r"(?:[.,·]\s?){5,}")
_BULLET = re.compile(r"^\s*(?:[—•–·*▪◦\-]|[oO](?= [A-Z]))\s+\S")
_NUMBERED = re.compile(rf"^\s*{_D}{{1,3}}\s*[.,)]\s*([A-ZÀ-Þ]\S*(?:\s+\S+){{0,3}})\s*$")
_LETTERED = re.compile(r"^\s*\(?\s*\w{1,2}\s*\)\s*\S.*[,.]\s*\S{1,4}\s*$")
_COLUMNED = re.compile(r"^[A-ZÀ-Þ0-9|!1]{3,}\s*[:;]\s*\S+, *\S")
_ADDRESS = re.compile(rf"^\S+[.,]\s*[A-Z0-9|][.,]{{1,2}}\s*{_D}+\s*\S+\s*[A-Z5]\w?[.,]?$")
_SHIP = re.compile(rf"(?:^(?:Arr|Sld|Dep|Cld|Sail|Off|Pass|Spoken|Ent)\w*[.,]\s.*,)|(?:,\s*{_D}+\s*t[.,]{{1,2}}\s)")
_NOTICE = re.compile(r"^\S{3,}(?:\s*—\s*\S+)*\s*[—–-]\s*(?:At|On|In)\b.*")
_SCORE = re.compile(rf"^\S+\s+\S[.,]?\s*\S+\s+\S[.,]?\s*\S+\s*{_D}*$")
_SHOUT = re.compile(r"^(?:\W*\w+\s*!\s*){2,}$")
_STARS = re.compile(r"^\W{2,}\s*[A-ZÀ-Þ0-9 ]+\s*\W{2,}$")
_OFFER = re.compile(
    rf"^(?:Apply\s|PRICE\s|WANTED\b|TO LET\b|FOR SALE\b|LOST\b|FOUND\b|Sold Every|NO REASONABLE|Box\s*{_D}+,\s*this|{_D}+\s+\S+\s+(?:Street|Road|Lane|Row|Square|Place|Terrace|Quay|Avenue)\b.*,\s*\S+$)"
    rf"|\sfrom\s*{_D}+/{_D}+\W*$|^[A-ZÀ-Þ0-9|]{{3,}}['’][A-Z5]\s+[A-ZÀ-Þ0-9|]+\W*$|^[A-ZÀ-Þ0-9|]{{4,}},\s+[A-Z][a-zà-ÿ0-9|!]+\.?$|&\s*Co\b"
)
_WORD = re.compile(r"[^\W\d_]+")
_VOWEL = re.compile("[aeiouyäöüáéíóúàèùâêîôûœæ]")
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxzß]{5,}|^[bcdfghjklmnpqrstvwxzß]{3,}$|[bcdfghjkmpqtvwxz]{4,}|j[bcdfghjklmnpqrstvwxz]|q[^u]|[vwxz][kqxzvfjg]|[bcdfgpt][qxj]")


def line_kind(line: str, common: frozenset[str]) -> int:
    """The kind of one line that is not blank."""
    s = line.strip()
    tokens = s.split()
    # Running text is full of common words; lines with a list's or a notice's marks are looked at closely.
    plain = sum(map(common.__contains__, tokens))
    if plain >= 2 and plain * 6 >= len(tokens) and s[0].isalpha() and s[1:2] != ")" and "—" not in s and "...." not in s and len(s) >= 3.9 * len(tokens):
        return PROSE
    words = _WORD.findall(s)
    if not words:
        figures = sum(map(str.isdigit, s))
        return TABLE if figures >= 2 and len(tokens) >= 2 else JUNK
    n = len(tokens)
    if s[0] in "|¦" and n > 2 or tokens.count("|") >= 2:
        return TABLE
    if _SHOUT.match(s) or _STARS.match(s) or _OFFER.search(s):
        return ADVERT
    if n >= 3 and len(set(tokens)) == 1 or n >= 4 and 2 * len(set(tokens)) <= n:
        return JUNK
    if _LEADER.search(s):
        return TABLE
    if 2 * sum(map(str.isalnum, s)) < sum(map(len, tokens)):
        return JUNK
    lower = [w for w in words if w[0].islower()]
    known = sum(w.lower() in common for w in words)
    if not s.isascii() and sum(c > "ſ" and c not in "—–‘’“”•…°" for c in s) * 12 > len(s):
        return JUNK
    if _BULLET.match(s):
        return LIST
    figures = sum(1 for t in tokens if any(c.isdigit() for c in t) and _FIGURE.match(t))
    if figures >= 2 and known == 0 and 2 * figures >= n - 1 and len(lower) <= 2:
        return TABLE
    if _COLUMNED.match(s) or (s[0] in "(rtf[{" or s[1:2] == ")") and _LETTERED.match(s) and known <= 1 or _ADDRESS.match(s) or _NOTICE.match(s):
        return LIST
    if _SHIP.search(s) and known <= 2:
        return LIST
    if n <= 7 and len(lower) <= 3 and figures and _SCORE.match(s) and known == 0:
        return LIST
    if (m := _NUMBERED.match(s)) and known == 0:
        return LIST
    if n >= 4 and len(lower) >= 0.6 * len(words):
        odd = sum(1 for w in lower if _CLUSTER.search(w))
        if odd >= 0.3 * len(lower) and known <= 0.25 * len(words):
            return JUNK
        letters = sum(map(len, words))
        if n >= 6 and (letters < 2.9 * len(words) and len(lower) == len(words) or letters < 3.1 * len(words) and known < 0.3 * len(words)):
            return JUNK
    elif lower and len(words) <= 3 and known == 0 and all(len(w) > 3 and not _VOWEL.search(w) for w in lower):
        return JUNK
    return PROSE


def not_prose(text, common):
    """Whether more than half of a page's lines are no prose, or it has no words."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return not _WORD.search(text or "") or 2 * sum(line_kind(x, common) != PROSE for x in lines) > len(lines)
