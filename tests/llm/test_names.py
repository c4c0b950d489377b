from __future__ import annotations

import collections
import itertools
import random

from lodestrata.llm.names import Trie, address, link, near_words, tokens, variant_pairs


def distance(a, b):
    """Edits with neighbouring letters swapped as one."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
        if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def vocabulary(seed, n=250):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(n)})


def test_automaton_against_brute_force():
    words = vocabulary(1)
    trie = Trie(words)
    for bound in (1, 2):
        for w in words[:60]:
            assert dict(trie.within(w, bound)) == {v: distance(w, v) for v in words if distance(w, v) <= bound}


def test_shards_lose_no_pair(spark):
    words = vocabulary(2, 400)
    got = {(r["a"], r["b"]) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    want = {(a, b) for a in words for b in words if a != b and distance(a, b) == 1}
    assert got == want
    # the same where tries may hold next to nothing, so that nearly all words go by their rests
    few = near_words(spark.createDataFrame([(w,) for w in words], "word string"), trie_words=3)
    assert {(r["a"], r["b"]) for r in few.collect()} == want


def test_words_that_all_end_alike_are_no_one_trie(spark):
    """100,000 domains with one ending: no row of the tries holds more than a bounded number of them."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) + ".com" for _ in range(101_000)})[:100_000]
    got = near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    have, letters = set(words), "abcdefghijklmnopqrstuvwxyz"
    for w in words[::5000]:
        near = {w[:i] + c + w[i + 1 :] for i in range(5) for c in letters} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(4)}
        assert {r["b"] for r in got if r["a"] == w} == (near & have) - {w}
    assert max(collections.Counter(r["a"] for r in got).values()) < 200


def test_parts():
    assert tokens("Gájatirn,  Benjamin S. (castorsys)") == ("benjamin", "gajatirn") and tokens("Yusuf.Gezojor") == ("gezojor", "yusuf")
    assert tokens("The Povefa Circuit Cursor Team") == ("circuit", "cursor", "povefa") and tokens(None) == () and tokens("  ") == ()
    assert address(" A.B+tag@WS-08.orbit.example")[0] == "a.b@orbit.example" and address("12+ab@users.noreply.x.example")[0].startswith("12+")
    assert address(None)[3] and address("git@localhost.test")[3] and not address("a@b.example")[3]


ROWS = [
    (1, "Emil Toginist", "emil.toginist@one.example", "r"), (2, "Toginist, Emil", "etoginist@ws-01.one.example", "r"), (3, "Eiml Toignist", "EMIL.TOGINIST@one.example", "r"),
    (4, "Emil Tginist", None, "q"), (5, None, "etoginist@one.example", "r"), (6, "ET", "etoginist+x@one.example", "r"),
    # the same name elsewhere is another person
    (10, "Rafael Sonopem", "rsonopem@one.example", "r"), (11, "Rafael Sonopem", "rafael.sonopem@two.example", "s"), (12, "Rafael Sonopem", None, "s"), (13, "Sonopem Rafael", None, "z"),
    # an address that many share
    (20, "Ada Lodinor", "git@localhost.test", "r"), (21, "Vera Gamalav", "git@localhost.test", "r"), (22, "Noor Tefofock", "git@localhost.test", "r"),
    (23, "Ada Lodinor", "ada.lodinor@one.example", "r"),
    # nicknames, organisations, nobody
    (30, "Frederik Gijobell", "fgijobell@one.example", "r"), (31, "Rik Gijobell", None, "r"),
    (40, "Repati Transfer & Stream Ltd.", "team@repati.example", "r"), (41, "repati-transfer-stream", None, "r"),
    (50, "unknown", None, "r"), (51, "root", "root@x.example", "r"), (52, None, None, "r"), (53, "", "", "r"),
]


def pairs_of(spark, rows):
    ids = spark.createDataFrame([(i, a, e) for i, a, e, _ in rows], "identity_id long, author string, author_email string")
    parts = spark.createDataFrame([(a, e, r) for _, a, e, r in rows], "author string, author_email string, repo string")
    return {(r["identity_a"], r["identity_b"]) for r in variant_pairs(ids, parts, parts.withColumnRenamed("author", "author_name").limit(0)).collect()}


def test_an_address_of_one_person_under_many_spellings(spark):
    rows = [(1, "Vera Gamalav", "vg@one.example", "r"), (2, "Wera Gamalav", "vg@one.example", "r"), (3, "Veronika Gamalav", "vg@one.example", "q"), (4, None, "vg@one.example", "r")]
    # the same, but three people with nothing in common
    rows += [(11, "Ada Lodinor", "team@two.example", "r"), (12, "Noor Tefofock", "team@two.example", "r"), (13, "Emil Toginist", "team@two.example", "r")]
    assert pairs_of(spark, rows) == set(itertools.combinations((1, 2, 3, 4), 2))


def test_short_tokens_hold_edits_if_the_whole_name_exists(spark):
    rows = [(1, "Liu Gamalav", "liu.gamalav@one.example", "r"), (2, "Gamalav, Liu", "liu@one.example", "r"), (3, "Lui Gamalav", None, "r")]
    rows += [(11, "Kim Lodinor", "kim.lodinor@two.example", "r"), (12, "Jim Tefofock", "jim.tefofock@two.example", "r"), (13, "Jim Lodinor", "jim.lodinor@two.example", "r")]
    assert pairs_of(spark, rows) == {(1, 2), (1, 3), (2, 3)}


def test_open_mailboxes_by_their_own_names_alone(spark):
    """Any number of people: a mailbox whose people have companies elsewhere is open, a company with a second domain is not."""
    people = [f"{a}{b} {c}{d}" for a, b, c, d in zip(("Ada", "Vera", "Noor", "Emil", "Juno", "Otis", "Ines", "Lars", "Mina", "Pavel"), "abcdefghij", ("Lodin", "Gamal", "Tefof", "Togin", "Sonop", "Gijob", "Repat", "Povef", "Gajat", "Mulek"), "qrstuvwxyz", strict=True)]
    rows = [(i, p, f"{p.split()[0].lower()}@mail.example", "r") for i, p in enumerate(people)]
    rows += [(100 + i, p, f"{p.split()[0].lower()}@firm{i}.example", "r") for i, p in enumerate(people)]
    # another person of the same name at another firm also has an address there
    rows += [(200, people[0], "a2@firm77.example", "s"), (201, people[0], "a2@mail.example", "s")]
    got = pairs_of(spark, rows)
    assert {(i, 100 + i) for i in range(1, 10)} <= got and (100, 200) not in got
    # and if they have the same second firm, the first is none that anybody can be at
    rows = [(i, p, f"{p.split()[0].lower()}@firm.example", "r") for i, p in enumerate(people)]
    rows += [(100 + i, p, f"{p.split()[0].lower()}@firm-two.example", "r") for i, p in enumerate(people)]
    assert (0, 100) not in pairs_of(spark, rows)


def test_people(spark):
    ids = spark.createDataFrame([(i, a, e) for i, a, e, _ in ROWS] + [(1, "Emil Toginist", "emil.toginist@one.example")], "identity_id long, author string, author_email string")
    parts = spark.createDataFrame([(a, e, r) for _, a, e, r in ROWS], "author string, author_email string, repo string")
    raw = parts.withColumnRenamed("author", "author_name").limit(0)
    got = {(r["identity_a"], r["identity_b"]) for r in variant_pairs(ids, parts, raw).collect()}
    groups = [(1, 2, 3, 4, 5, 6), (11, 12), (20, 23), (30, 31), (40, 41)]
    assert got == {p for g in groups for p in itertools.combinations(g, 2)}


def test_empty(spark):
    ids = spark.createDataFrame([], "id long, author string, email string")
    uses = spark.createDataFrame([], "author string, email string, repo string")
    assert link(ids, uses).count() == 0
