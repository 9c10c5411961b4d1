"""Names and addresses: the join against brute force, and what is linked."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.llm import addresses as AD
from foliospark.llm import links as L
from foliospark.llm import names as N


def levenshtein(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        last = row
    return last[-1]


def test_join_is_complete(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 16))) for _ in range(60)]
    rows = []
    for i in range(240):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randrange(len(s) + 1), rng.randrange(3)
            if kind == 0:
                s.insert(at, rng.choice("abcd"))
            elif s and kind == 1:
                s.pop(min(at, len(s) - 1))
            elif s:
                s[min(at, len(s) - 1)] = rng.choice("abcd")
        rows.append((i, rng.choice("xy"), "".join(s)))
    df = spark.createDataFrame(rows, "id bigint, block string, s string")
    for most in (N.allowed_edits, AD.street_edits):
        got = {tuple(r) for r in L.similar_pairs(df, df, most).collect()}
        want = {(a, b) for a, x, s in rows for b, y, t in rows if a != b and x == y and s and t and levenshtein(s, t) <= most(min(len(s), len(t)))}
        assert got == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 10), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    e = spark.createDataFrame(edges, "a bigint, b bigint")
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 10, 11, 50, *range(100, 141))], "id bigint")
    got = {r["id"]: r["component"] for r in L.components(e, v).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 10: 10, 11: 10, 50: 50, **{i: 100 for i in range(100, 141)}}
    assert L.components(e.where("false"), v).count() == 48


def test_edit_distance():
    assert N.edits("jhon", "john", 2) == 1 and N.edits("abc", "abc", 0) == 0 and N.edits("abcdef", "xyz", 2) == 3 and N.edits("", "ab", 2) == 2


ONE = ["Kepe Sedetru Engineering Private Limited", "KEPE SEDETRU ENG. (P) LTD", "Kepesedetru Eng. Private Ltd,", "Kepe-Sedetru Engg. (P) Ltd.", "M/s Kepe Sedetroo Engineering P. Ltd", "Engineering, Kepe Sedetru", "SEDETRU KEPE ENGINEERING", "K. Sedetru Engg"]
TWO = ["Margaret Gigok Sunrofo", "MARGARET GIGOC SUNROFO", "Peggy Sunrofo", "M/s M. Gigok Sunrofo", "DR. MARGARET GIGOUK SUNROUFOU", "Sunrofo, Margaret Gigok", "margaretgigok sunrofo"]
APART = ["Kepe Sedetru Textiles", "Robert Gigok Sunrofo", "Mary Gigok Sunrofo", None, "", "-", "NA", "  ", "cash"]


def cards(spark, texts, column):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], f"entity_id bigint, {column} string, form string, cluster int")
    return df


def linked(df, op, n):
    pairs = {tuple(r) for r in op(df).collect()}
    return pairs, n


def test_names_that_mean_one(spark):
    texts = ONE + TWO + APART
    pairs = {tuple(r) for r in N.same_names(cards(spark, texts, "entity_name")).collect()}
    a, b = range(len(ONE)), range(len(ONE), len(ONE) + len(TWO))
    want = {(i, j) for g in (a, b) for i in g for j in g if i < j}
    # An initial that fits Margaret and Mary alike stays alone.
    m = len(ONE) + 3
    assert pairs == {p for p in want if m not in p}


def test_names_edges(spark):
    long = "Kepe " + "Sedetru" * 3000 + " Engineering"
    df = cards(spark, [long, long, "ab", "a", "1234", "Engineering", "M/s"], "entity_name")
    assert {tuple(r) for r in N.same_names(df).collect()} == {(0, 1)}
    again = df.unionByName(df).unionByName(df.select(F.lit(None).cast("bigint").alias("entity_id"), "entity_name", "form", "cluster"))
    assert {tuple(r) for r in N.same_names(again).collect()} == {(0, 1)}
    assert N.same_names(df.where("false")).count() == 0


PLACE = ["386, Zelbet Tirbumak Marg, Fitnor Gunj, Zuzekgaon, Kantipradesh, 425006", "No. 386 Zelbet Tirbumak Mrg|Zuzekgaon|425 006", "plot no.386 z. tirbumak marg; zuzekgaon; ktp", "PIN 425006, ZUZEKGAON, ZELBETTIRBUMAK MG. H.NO. 386", "386, Zelbet Tirbumka Marg, Zuzekgaon", "Zelbet Tirbumak 386, Near Clock Tower, 425006"]
ELSE = ["387, Zelbet Tirbumak Marg, Fitnor Gunj, Zuzekgaon, Kantipradesh, 425006", "Shop 4, 386, Zelbet Tirbumak Marg, Fitnor Gunj, Zuzekgaon, Kantipradesh, 425006", "386, Other Nearwood Marg, Fitnor Gunj, Zuzekgaon, Kantipradesh, 425006", "386, Zelbet Tirbumak Marg, Fitnor Gunj, Momekot, Neelgarh, 710006", "same as above", "NA", "-", "", None]


def test_addresses_that_mean_one(spark):
    pairs = {tuple(r) for r in AD.same_addresses(cards(spark, PLACE + ELSE + PLACE[:1] * 2, "entity_address")).collect()}
    same = [*range(len(PLACE)), len(PLACE + ELSE), len(PLACE + ELSE) + 1]
    assert pairs == {(i, j) for i in same for j in same if i < j}


def test_addresses_edges(spark):
    long = "386, " + "Zelbet " * 5000 + "Marg, Zuzekgaon"
    df = cards(spark, [long, long, "386", "road", "Zuzekgaon", "\n\n", "PIN 425006"], "entity_address")
    assert {tuple(r) for r in AD.same_addresses(df).collect()} == {(0, 1)}
    assert AD.same_addresses(df.where("false")).count() == 0


@pytest.mark.parametrize("text,unit,number,kind", [
    ("Off. No. B-49, #20/2 Donar Nifotac Street", "office b49", "20/2", "street"), ("Shop#17 D.No 95 Molse Kuviu Road Likdaganj 683 035", "shop 17", "95", "road"), ("111-8 retun foninves x road; gdn no b-3", "godown b3", "111/8", "cross road"), ("Flt 11A, 34/23A Pisto Gali", "flat 11a", "34/23a", "lane"),
])
def test_reading(text, unit, number, kind):
    p = AD.read_address(text)
    assert (p["unit"], p["number"], p["kind"]) == (unit, number, kind)


def test_misspelt_town_beside_a_run_together_street(spark):
    # No postal code, the town misspelt, the street one word with an edit of its own: only the town's streets can settle it.
    odd = ["386 ZELBETTIRBUMEK MG., FITNOR GUNJ, ZUZEKGON, KTP", "Zuzekgoan; Fitnor Gunj; Zelbettirbumka Marg #386"]
    # Two words of a street in no town are a street still.
    street = ["386, Zelbet Tirbumak Marg"]
    # That KTP is a region shows in other towns' addresses.
    others = [f"{i + j} Rimok Salvetun Marg, {t}, {r}, {p}001" for p, t in (("431", "Bergholm"), ("432", "Lundwick"), ("433", "Dahlsted")) for i in (1, 20) for j, r in enumerate(("Kantipradesh", "KTP"))]
    n = len(PLACE + odd + street)
    pairs = {tuple(r) for r in AD.same_addresses(cards(spark, PLACE + odd + street + others, "entity_address")).where(f"entity_id_a < {n}").collect()}
    assert pairs == {(i, j) for i in range(n) for j in range(i + 1, n)}


def test_components_are_whole_or_an_error(spark):
    n = 40
    edges, vertices = spark.createDataFrame([(i, i + 1) for i in range(n)], "a bigint, b bigint"), spark.range(n + 2)
    assert {r["id"]: r["component"] for r in L.components(edges, vertices).collect()} == {i: i if i > n else 0 for i in range(n + 2)}
    with pytest.raises(RuntimeError):
        L.components(edges, vertices, rounds=2)


def test_last_words_and_middle_initials_are_no_given_names():
    assert N.parse_name("Mike Johnson")[4] == N.fold("johnson") and N.parse_name("Johnson")[4] == N.fold("johnson")
    assert N.parse_name("Suresh K Sharma")[0] == "other" and N.parse_name("Suresh K Sharma")[3:] == N.parse_name("Suresh Sharma")[3:]
    # Initials before or behind the words stand for the given name; a given name may run into the word behind it.
    assert N.parse_name("F. P. Ronfirfum")[:3] == N.parse_name("Ronfirfum F. P.")[:3] == ("person", "f", "p")
    assert N.parse_name("johngigok sunrofo")[:2] == N.parse_name("Sunrofo, Johngigok")[:2] == ("person", "john")


def test_regions_and_towns_come_from_the_addresses(spark):
    """Regions nobody listed: parts that recur in several postal prefixes; a town recurs in one."""
    towns = {"Zuzekgaon": ("425", "Ultima Terra"), "Momekot": ("426", "Ultima Terra"), "Hisarpat": ("427", "Ultima Terra"), "Bergholm": ("428", "Norland"), "Lundwick": ("429", "Norland"), "Dahlsted": ("430", "Norland")}
    rows = [f"{10 + i}, Street{'abcdef'[i % 6] * 4} Tirbumak Marg, {t}, {r}, {p}00{i}" for t, (p, r) in towns.items() for i in range(8)]
    more = ["10, Streetaaaa Tirbumak Marg, Zuzekgaon Ultima Terra", "10, Streetaaaa Tirbumak Marg, Zuzekgaon, Ultime Terra, 425000", "10, Streetaaaa Tirbumak Marg, Zuzekgaon"]
    df = cards(spark, rows + more, "entity_address")
    read = df.select(F.col("entity_address").alias("address")).mapInArrow(AD._read_all, "address string, pin3 string, unit string, number string, parts array<string>, whole array<string>")
    regions = AD.regions_of(read)
    assert regions == {"ultima tera", "norland"}
    assert set(AD.towns_of(read, regions).values()) == {AD.fold(t.lower()) for t in towns}
    got = {tuple(r) for r in AD.same_addresses(df).collect()}
    n = len(rows)
    assert {(0, n), (0, n + 1), (0, n + 2)} <= got and not any(a < n and b < n for a, b in got)


@pytest.mark.parametrize("text,pin,number", [
    ("Vimgesgarh Taljuzul Bzr H.No. 372 686 006", "686006", "372"), ("F. Hitakba Mrg Plot 224 689 143 Nazotabad", "689143", "224"), ("689 143 224 Hitakba Street, Nazotabad", "689143", "224"),
    ("Hitakba Street 12, PIN 689 143 224", "689143", "12"), ("225, Hitakba Street - 461 013", "461013", "225"), ("758068,Mitzegarh,Laltu Gali, D.No 226/29", "758068", "226/29"),
])
def test_a_number_before_a_spaced_code(text, pin, number):
    p = AD.read_address(text)
    assert (p["pin"], p["number"]) == (pin, number)


def test_misread_codes_move_no_town(spark):
    """A town is where most of its addresses are, though some have codes misread to other prefixes; and it is no region for that."""
    street = [f"{i}, Zelbet Tirbumak Marg, Zuzekgaon, 4250{i}" for i in range(10, 75)]
    odd = [f"{i}, Rimok Salvetun Marg, Zuzekgaon, {p}0{i}" for p in ("125", "225", "326") for i in (10, 11)]
    ask = ["20, Zelbet Tirbumka Marg, Zuzekgaon", "21, Zelbet Tirbumka Marg, Zuzekgaon, 125021"]
    df = cards(spark, street + odd + ask, "entity_address")
    read = df.select(F.col("entity_address").alias("address")).mapInArrow(AD._read_all, "address string, pin3 string, unit string, number string, parts array<string>, whole array<string>")
    assert AD.regions_of(read) == frozenset() and AD.towns_of(read) == {"425": AD.fold("zuzekgaon")}
    n = len(street + odd)
    assert {tuple(r) for r in AD.same_addresses(df).where(f"entity_id_b >= {n}").collect()} == {(10, n), (11, n + 1)}
