"""Variant spellings of names typed by people: signatures of the same person or organisation are linked.

A signature is a name and an address as typed. Names are taken apart into tokens without case, accents, order, initials
and company words. The distinct tokens are sharded into tries, and a Levenshtein automaton (with neighbouring letters
swapped as one edit) is driven through each trie for each of its tokens, which gives every pair of tokens one edit apart. A token that
no address attests becomes its attested, or much more frequent, neighbour; nicknames become the name that exists. Token
order no longer matters then: a name is the sorted tuple of its tokens.

Signatures of one such name are one person if they share a company's domain; the same name at two companies is two people.
Signatures without a company (no address, a free mailbox, a hidden or shared address) join the only person of that name, or
of several the only one who mostly works in the same repository. An address links its signatures; where three names or more
use it, those that hold the token which most of them share, and none if there is no such token. Groups are the connected
components.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import spread
from lodestrata.operators.components import connected
from lodestrata.session import checkpointed

# Words that are no part of a name, and names that stand for nobody.
NOISE = frozenset("the team bot inc ltd llc gmbh ag co corp company and von de dr mr mrs ms jr sr".split())
NOBODY = frozenset({("name", "your"), ("name", "no"), ("committed", "not", "yet"), ("author", "unknown"), ("unknown", "user")})
# Nicknames and the names they are short for.
NICKNAMES = {
    "alex": "alexander alexandra", "sandy": "alexander alexandra", "sasha": "alexander alexandra", "xander": "alexander",
    "andy": "andrew andreas", "drew": "andrew", "becky": "rebecca", "becca": "rebecca", "ben": "benjamin", "benny": "benjamin",
    "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth",
    "lizzie": "elizabeth", "lisa": "elizabeth", "eliza": "elizabeth", "libby": "elizabeth", "bill": "william", "billy": "william",
    "will": "william", "liam": "william", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert",
    "chris": "christopher christine christian", "kit": "christopher", "topher": "christopher", "dan": "daniel", "danny": "daniel",
    "dora": "dorothea", "dory": "dorothea", "thea": "dorothea theodora", "dick": "richard", "rick": "richard", "rich": "richard",
    "richie": "richard", "fred": "frederik alfred", "freddy": "frederik", "rik": "frederik hendrik", "gabi": "gabriela", "gaby": "gabriela",
    "hannes": "johannes", "hans": "johannes", "jo": "johannes", "jen": "jennifer", "jenny": "jennifer", "kate": "katherine",
    "kathy": "katherine", "katie": "katherine", "kat": "katherine", "maggie": "margaret", "meg": "margaret", "peggy": "margaret",
    "max": "maximilian", "mike": "michael", "mick": "michael", "misha": "michael mikhail", "nick": "nicholas nikolai", "niko": "nikolai",
    "kolya": "nikolai", "paco": "francisco", "pancho": "francisco", "frank": "francisco", "rafa": "rafael", "raf": "rafael",
    "sam": "samuel", "sammy": "samuel", "sue": "susanna", "susi": "susanna", "susie": "susanna", "sanna": "susanna",
    "ted": "theodore", "theo": "theodore", "teddy": "theodore", "tom": "thomas", "tommy": "thomas", "tilly": "tilda", "steve": "stephen steven",
    "tony": "anthony antonio", "jim": "james", "joe": "joseph", "dave": "david", "ed": "edward", "matt": "matthew", "pete": "peter",
}
#: Names per address from which on it is only theirs who share a token.
SHARED = 3
#: Letters from which on a token may hold an edit on its own; of a shorter one the whole name has to exist without the edit.
SHORTEST = 4
#: Words of one trie, at most.
TRIE_WORDS = 4096
_LETTERS = {"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i", "ħ": "h"}
_HOST = re.compile(r"^(?:ws|pc|host|build|mail|smtp|mx|laptop|desktop|dev|vpn|node|srv)[-\d]*\.(?=[^.]+\.)")
_HIDDEN = re.compile(r"no-?reply|localhost|localdomain|\.local$|\.invalid$|(?:^|\.)none$")


def fold(text: str) -> str:
    """``text`` in lower case, without accents."""
    text = "".join(_LETTERS.get(c, c) for c in text.lower())
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def tokens(name: str | None) -> tuple[str, ...]:
    """The sorted tokens of a name: without notes in parentheses, initials, and words that are no name."""
    if not name:
        return ()
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", fold(name))
    found = sorted({t for t in re.findall(r"[^\W\d_]+", text) if len(t) > 1 and t not in NOISE})
    return tuple(found)


def address(email: str | None) -> tuple[str | None, str | None, str | None, bool]:
    """Normal address, its local part and domain, and whether it tells nothing of a company.

    Without case, blanks, tag after ``+`` and the machine in front of the domain; a number before ``+`` is kept.
    """
    if not email or "@" not in email:
        return None, None, None, True
    local, _, domain = email.strip().lower().rpartition("@")
    domain = _HOST.sub("", domain)
    if not re.match(r"^\d+\+", local):
        local = local.split("+", 1)[0]
    return f"{local}@{domain}", local, domain, bool(_HIDDEN.search(domain) or _HIDDEN.search(local))


def _features(rows: DataFrame) -> DataFrame:
    """``id, author, email`` taken apart: ``id, tokens, local, domain, hidden, attested``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [tokens(x) for x in b.column("author").to_pylist()]
            names = [() if t in NOBODY else t for t in names]
            mails = [address(x) for x in b.column("email").to_pylist()]
            attested = [[t for t in ts if m[1] and t in fold(m[1])] for ts, m in zip(names, mails, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    pa.array([list(t) for t in names], pa.list_(pa.string())),
                    pa.array([m[1] for m in mails], pa.string()),
                    pa.array([m[2] for m in mails], pa.string()),
                    pa.array([m[3] for m in mails], pa.bool_()),
                    pa.array(attested, pa.list_(pa.string())),
                ],
                ["id", "tokens", "local", "domain", "hidden", "attested"],
            )

    return spread(rows).mapInArrow(
        run, "id long, tokens array<string>, local string, domain string, hidden boolean, attested array<string>"
    )


class Trie:
    """A trie of words, searched with a Levenshtein automaton."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, word: str, bound: int = 1) -> Iterator[tuple[str, int]]:
        """The words at most ``bound`` edits from ``word``, and their distance.

        The state of the automaton after a prefix is the row of distances to the prefixes of ``word``, cut off beyond the
        bound; a branch is left when the whole row is. Two neighbouring letters swapped are one edit.
        """
        n, over = len(word), bound + 1
        first = tuple(min(i, over) for i in range(n + 1))
        stack = [(self.root, first, None, "")]
        while stack:
            node, row, before, last = stack.pop()
            for c, child in node.items():
                if not c:
                    if row[n] <= bound:
                        yield child, row[n]
                    continue
                new = [min(row[0] + 1, over)]
                for i in range(1, n + 1):
                    d = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (word[i - 1] != c))
                    if before is not None and i > 1 and word[i - 1] == last and word[i - 2] == c:
                        d = min(d, before[i - 2] + 1)
                    new.append(min(d, over))
                if min(new) <= bound:
                    stack.append((child, tuple(new), row, c))


def near_words(words: DataFrame, trie_words: int = TRIE_WORDS) -> DataFrame:
    """``a, b`` of all pairs of different words of ``words`` (column ``word``, distinct) one edit apart, both ways.

    One edit leaves the first or the last (m-1)//2 letters of both words alone, m being the shorter length. So a word
    goes to four tries: for the pairs with one letter less and with as many or one more, by its beginning and by its end.
    Where more than ``trie_words`` words meet under one key (domains that all end alike), they go to tries by what is left of
    them without one of their letters instead: words one edit apart have such a rest in common, and at most as many words
    as there are letters times places share one. So no trie and no row grows with the vocabulary, and no pair is lost.
    """
    n = F.length("word")
    keys = []
    for m in (n - 1, n):
        piece = F.greatest(F.floor((m - 1) / 2), F.lit(0)).cast("int")
        keys += [
            F.concat_ws(":", m.cast("string"), F.lit("begin"), F.expr("word").substr(F.lit(1), piece)),
            F.concat_ws(":", m.cast("string"), F.lit("end"), F.expr("word").substr(n - piece + 1, piece)),
        ]
    keyed = words.where(n > 0).select("word", F.explode(F.array(*keys)).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # one row per key that several words have
    sizes = checkpointed(sizes)
    small = keyed.join(sizes.where(F.col("n") <= trie_words).select("shard"), "shard", "left_semi")
    shards = small
    if not sizes.where(F.col("n") > trie_words).isEmpty():
        hot = keyed.join(sizes.where(F.col("n") > trie_words).select("shard"), "shard", "left_semi").select("word").distinct()
        rest = F.transform(
            F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("rest:"), F.expr("word").substr(F.lit(1), i - 1), F.expr("word").substr(i + 1, n))
        )
        itself = F.array(F.concat(F.lit("rest:"), F.col("word")))
        shards = small.unionByName(hot.select("word", F.explode(F.array_distinct(F.concat(rest, itself))).alias("shard")))
    shards = shards.groupBy("shard").agg(F.collect_list("word").alias("words")).where(F.size("words") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for ws in batch.column("words").to_pylist():
                trie = Trie(ws)
                for w in ws:
                    for other, d in trie.within(w):
                        if d:
                            a.append(w)
                            b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    return shards.mapInArrow(run, "a string, b string").distinct()


def _corrections(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``word, right`` of the words that are misspelt, and ``word, other`` of the short ones that may be.

    ``weights``: ``word, weight, attested``.

    A word that is attested stays. Another becomes its neighbour that is attested, else one at least eight times, or at
    weight one or two just more, frequent; of several the attested, the most frequent, the first in the alphabet.
    """
    from_, to = weights.alias("f"), weights.alias("t")
    better = (F.col("t.attested") > 0) | (
        (F.col("t.weight") >= 8 * F.col("f.weight")) | ((F.col("f.weight") <= 2) & (F.col("t.weight") > F.col("f.weight")))
    )
    near = (
        near_words(weights.select("word"))
        .join(from_, F.col("a") == F.col("f.word"))
        .where(F.col("f.attested") == 0)
        .join(to, F.col("b") == F.col("t.word"))
        .where(better)
    )
    near = checkpointed(near.select(F.col("f.word").alias("word"), F.col("t.word").alias("other"), F.col("t.weight").alias("weight"), F.col("t.attested").alias("attested")))
    long = (F.length("word") >= SHORTEST) & (F.length("other") >= SHORTEST)
    best = F.max_by(
        F.col("other"),
        F.struct((F.col("attested") > 0), F.col("weight"), F.reverse(F.transform(F.split("other", ""), lambda c: -F.ascii(c)))),
    )
    return near.where(long).groupBy("word").agg(best.alias("right")), near.where(~long).select("word", "other")


def _stars(rows: DataFrame, *key: str) -> DataFrame:
    """Edges from each row's ``id`` to the smallest one with the same key."""
    least = rows.groupBy(*key).agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return rows.join(least, list(key)).select(F.col("id").alias("u"), "v")


def signatures(identities: DataFrame, uses: DataFrame) -> DataFrame:
    """Signatures taken apart, with their name brought into its right spelling: one row per ``id``.

    ``identities``: ``id, author, email``; ``uses``: ``author, email, repo`` of each commit row.
    """
    per_repo = uses.where(F.col("repo").isNotNull()).groupBy("author", "email", "repo").agg(F.count(F.lit(1)).alias("n"))
    homes = per_repo.groupBy(F.col("author").alias("u_author"), F.col("email").alias("u_email")).agg(
        F.max_by("repo", F.struct("n", "repo")).alias("home")
    )
    ids = identities.join(
        homes, F.col("author").eqNullSafe(F.col("u_author")) & F.col("email").eqNullSafe(F.col("u_email")), "left"
    ).select("id", "home")
    feats = checkpointed(_features(identities.select("id", "author", "email")).join(ids, "id"))

    weights = (
        feats.select(F.explode("tokens").alias("word"), "attested")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("weight"), F.sum(F.array_contains("attested", F.col("word")).cast("int")).alias("attested"))
    )
    words, short = _corrections(weights)
    domains, _ = _corrections(
        feats.where(~F.col("hidden"))
        .groupBy(F.col("domain").alias("word"))
        .agg(F.count(F.lit(1)).alias("weight"))
        .withColumn("attested", F.lit(0))
    )
    domains = domains.select(F.col("word").alias("domain"), F.col("right").alias("right_domain"))
    named = (
        feats.select("id", F.explode("tokens").alias("word"))
        .join(words, "word", "left")
        .groupBy("id")
        .agg(F.array_sort(F.collect_set(F.coalesce("right", "word"))).alias("name"))
    )
    out = (
        feats.join(named, "id", "left")
        .join(domains, "domain", "left")
        .select(
            "id",
            F.when(F.size("name") >= 2, F.array_join("name", " ")).alias("name"),
            "local",
            F.coalesce("right_domain", "domain").alias("domain"),
            "hidden",
            "home",
        )
    )
    return checkpointed(_without_nicknames(_as_existing(out, short)))


def _as_existing(rows: DataFrame, short: DataFrame) -> DataFrame:
    """Names with a short token (``short``: ``word, other``) become the only more frequent name that has the other one."""
    names = rows.where(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("name", " ")
    known = names.select(F.col("name").alias("right"), F.col("n").alias("m"))
    cand = (
        names.select("name", "n", parts.alias("parts"), F.explode(parts).alias("word"))
        .join(short, "word")
        .select("name", "n", F.array_join(F.array_sort(F.array_union(F.array_remove("parts", F.col("word")), F.array("other"))), " ").alias("right"))
        .join(known, "right")
        .where(F.col("m") > F.col("n"))
        .groupBy("name")
        .agg(F.min("right").alias("right"), F.count_distinct("right").alias("k"))
        .where(F.col("k") == 1)
        .select("name", "right")
    )
    return rows.join(cand, "name", "left").withColumn("name", F.coalesce("right", "name")).drop("right")


def _without_nicknames(rows: DataFrame) -> DataFrame:
    """Names with a nickname become the only existing name that it can stand for."""
    table = F.create_map(*[x for k, v in NICKNAMES.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v.split()]))])
    names = rows.where(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("name", " ")
    cand = (
        names.select("name", parts.alias("parts"), F.explode(parts).alias("nick"))
        .withColumn("full", F.explode(table[F.col("nick")]))
        .select("name", F.array_join(F.array_sort(F.array_union(F.array_remove("parts", F.col("nick")), F.array("full"))), " ").alias("longer"))
        .join(names.select(F.col("name").alias("longer")), "longer")
        .groupBy("name")
        .agg(F.min("longer").alias("longer"), F.count_distinct("longer").alias("k"))
        .where(F.col("k") == 1)
        .select("name", "longer")
    )
    return rows.join(cand, "name", "left").withColumn("name", F.coalesce("longer", "name")).drop("longer")


def link(identities: DataFrame, uses: DataFrame) -> DataFrame:
    """``id, group``: the signatures with the smallest id of their person or organisation.

    Defined cases: a signature without name or without address is linked by the other; one with neither, or a name of one
    token only and no address of its own, is alone; repeated ids are one signature; placeholders are nobody; no rows give
    no rows.
    """
    sigs = signatures(identities.where(F.col("id").isNotNull()).dropDuplicates(["id"]), uses)

    # addresses that are one person's
    mail = sigs.where(F.col("domain").isNotNull()).select("id", F.concat_ws("@", "local", "domain").alias("mail"), "name")
    used = mail.where(F.col("name").isNotNull()).select("mail", "name").distinct()
    names_of = used.groupBy("mail").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= SHARED)
    # the token that most of the names share; a sum per address and token, so a shared mailbox is no group of names
    theirs = (
        used.join(names_of, "mail")
        .select("mail", "k", F.explode(F.split("name", " ")).alias("token"))
        .groupBy("mail", "k", "token")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") * 2 > F.col("k"))
        .groupBy("mail")
        .agg(F.max_by("token", F.struct("n", "token")).alias("token"))
    )
    mail = (
        mail.join(names_of, "mail", "left")
        .join(theirs, "mail", "left")
        .where(F.col("k").isNull() | (F.col("token").isNotNull() & (F.col("name").isNull() | F.array_contains(F.split("name", " "), F.col("token")))))
    )

    # Mailboxes anybody can have: most of their names are also, in the same repository, at another domain, and no other
    # domain stands out. Of a name's other domains one stands for all, so that nothing is paired.
    full = sigs.where(F.col("name").isNotNull())
    at = full.where(~F.col("hidden")).select("name", "home", "domain").distinct()
    ends = at.groupBy(F.col("name").alias("e_name"), F.col("home").alias("e_home")).agg(F.min("domain").alias("first"), F.max("domain").alias("last"))
    other = F.when(F.col("domain") != F.col("first"), F.col("first")).when(F.col("domain") != F.col("last"), F.col("last"))
    elsewhere = (
        at.where(F.col("home").isNotNull())
        .join(ends, (F.col("name") == F.col("e_name")) & (F.col("home") == F.col("e_home")))
        .groupBy("domain", other.alias("other"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # with two more of the first kind and two more of the others, so that few names tell nothing
    open_domains = (
        elsewhere.groupBy("domain")
        .agg(
            F.sum("n").alias("names"),
            F.coalesce(F.sum(F.when(F.col("other").isNotNull(), F.col("n"))), F.lit(0)).alias("elsewhere"),
            F.coalesce(F.max(F.when(F.col("other").isNotNull(), F.col("n"))), F.lit(0)).alias("top"),
        )
        .where((F.col("elsewhere") * 2 >= F.col("names")) & ((F.col("top") + 2) * 3 < F.col("elsewhere") + 4))
        .select("domain", F.lit(True).alias("is_open"))
    )
    full = (
        full.join(open_domains, "domain", "left")
        .withColumn("company", F.when(~F.col("hidden") & F.col("is_open").isNull(), F.col("domain")))
        .select("id", "name", "company", "home")
    )
    full = checkpointed(full)

    # one address; one name at one company
    edges = _stars(mail.select("id", "mail"), "mail").union(
        _stars(full.where(F.col("company").isNotNull()).select("id", "name", "company"), "name", "company")
    )
    edges = checkpointed(edges)
    labels = connected(edges, one_task=0)
    placed = full.join(labels, full["id"] == labels["node"], "left").select(
        "id", "name", "company", "home", F.coalesce("label", "id").alias("group")
    )

    # Who shows no company joins the only group of that name that does; of several the only one at home in the same
    # repository. Where no group of the name shows one, they are one.
    firm = placed.groupBy("group").agg(F.max(F.col("company").isNotNull().cast("int")).alias("firm"))
    groups = placed.select("group", "name", "home").distinct().join(firm, "group")
    firm_group = F.when(F.col("firm") == 1, F.col("group"))
    per_name = groups.groupBy("name").agg(
        F.count_distinct(firm_group).alias("firms"), F.min(firm_group).alias("firm_group"), F.min("group").alias("any_group")
    )
    per_home = groups.groupBy("name", "home").agg(
        F.count_distinct(firm_group).alias("home_firms"), F.min(firm_group).alias("home_group")
    )
    choice = (
        F.when(F.col("firms") == 0, F.col("any_group"))
        .when(F.col("firms") == 1, F.col("firm_group"))
        .when(F.col("home_firms") == 1, F.col("home_group"))
    )
    joins = (
        groups.where(F.col("firm") == 0)
        .join(per_name, "name")
        .join(per_home, ["name", "home"], "left")
        .groupBy(F.col("group").alias("u"))
        .agg(F.min(choice).alias("v"), F.max(choice).alias("w"))
        .where(F.col("v") == F.col("w"))
        .select("u", "v")
    )
    final = connected(edges.union(joins), one_task=0)
    return (
        identities.select("id")
        .where(F.col("id").isNotNull())
        .distinct()
        .join(final, F.col("id") == F.col("node"), "left")
        .select("id", F.coalesce("label", "id").alias("group"))
    )


def variant_pairs(identities: DataFrame, commit_parts: DataFrame, raw_commits: DataFrame) -> DataFrame:
    """``identity_a, identity_b`` (a < b): every pair of identities of one person or organisation."""
    uses = commit_parts.select("author", F.col("author_email").alias("email"), "repo").unionByName(
        raw_commits.select(F.col("author_name").alias("author"), F.col("author_email").alias("email"), "repo")
    )
    ids = identities.select(F.col("identity_id").alias("id"), "author", F.col("author_email").alias("email"))
    groups = checkpointed(link(ids, uses))
    a = groups.select(F.col("id").alias("identity_a"), "group")
    b = groups.select(F.col("id").alias("identity_b"), "group")
    return a.join(b, "group").where(F.col("identity_a") < F.col("identity_b")).select("identity_a", "identity_b")
