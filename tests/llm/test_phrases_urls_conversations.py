"""Conversation repair, URL filters and phrase mining against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quayline.llm import queries
from quayline.llm.conversation_repair import damage, lightest_repair, repair_conversations
from quayline.llm.phrases import collocations
from quayline.llm.url_filter import filter_urls, host_and_path, path_templates

# ---- conversations ------------------------------------------------------------

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """Every edit sequence with at most two inserts in a row."""
    best = None
    inserts = [""] + ["u", "a"] + ["ua", "au", "uu", "aa"]
    options = []
    for own, fault in rows:
        stay = 3 if fault == "truncated" else 0
        here = [(4, "D", "")]
        if fault not in ("blank", "duplicate"):
            here += [(stay, "K", own), (3 + stay, "R", "u"), (3 + stay, "R", "a")]
        options.append(here)
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(*options):
            roles = audit = ""
            cost = 0
            for gap, edit in itertools.zip_longest(gaps, edits):
                roles, audit, cost = roles + gap, audit + "I" * len(gap), cost + 3 * len(gap)
                if edit:
                    roles, audit, cost = roles + edit[2], audit + edit[1], cost + edit[0]
            if GRAMMAR.match(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_lightest_derivation_is_the_cheapest_edit_sequence():
    faults = ["", "", "blank", "duplicate", "truncated"]
    cases = [[(i, f)] for i in "suat" for f in set(faults)] + [[]]
    cases += [list(zip(p, [""] * 2)) for p in itertools.product("suat", repeat=2)]
    rng = random.Random(3)
    cases += [[(rng.choice("sua x"), rng.choice(faults)) for _ in range(3)] for _ in range(25)]
    for rows in cases:
        cost, audit, targets = lightest_repair(rows)
        assert (cost, audit) == cheapest(rows), rows
        assert GRAMMAR.match("".join(t for t in targets if t))


def test_long_conversation_is_linear():
    rows = [("u" if i % 2 == 0 else "a", "") for i in range(40000)] + [("a", ""), ("s", "")]
    cost, audit, _ = lightest_repair(rows)
    assert cost == 6 and audit == "K" * 40000 + "RR"


def by_hand(rows):
    """The contract in plain Python: {conv_id: row}."""
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        part = [" " if v is None else str(v) for v in (c, turn)]
        kind = zlib.crc32(":".join(part).encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        conv[c]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        conv[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c, mine in conv.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                          else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in mine]
        cost, audit, targets = lightest_repair(list(zip(initials, faults)))
        kept, rest = [], iter(mine)
        for letter, target in zip(audit, targets):
            row = None if letter == "I" else next(rest)
            if letter != "D":
                kept.append((row[1] if letter == "K" else {"u": "user", "a": "assistant"}[target]) + ":" + (row[2] if row else ""))
        turns = [r[0] for r in mine if r[0] is not None]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                  faults.count("duplicate"), faults.count("truncated"),
                  sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
                  hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(11)
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 9)):
            text = rng.choice(["Hello there.", "Why?", "no end", " \t\n", "", "Ja! ", "Fin.\n", "été…", "x" * 50 + "."])
            rows.append((c, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), text + str(rng.randrange(3)) * rng.randrange(2)))
    rows += [(None, 0, "user", "a."), (None, None, None, None), (500, None, "user", "A."), (500, None, "user", "A."),
             (501, 7, "tool", "made up."), (501, 3, "", "."), (502, 1, "user", None), (502, 1, None, "b!"), (503, 2, "assistant", "z" * 200000)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_conversations_equal_the_contract(spark, tmp_path):
    rows = conversations()
    given = spark.createDataFrame([(*r, "k", 1, "x") for r in rows], SCHEMA + ", kind string, copy int, present string")
    given.repartition(7).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == len({r[0] for r in rows})
    want = by_hand(rows)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id], r.conv_id


def test_conversations_empty_dropped_and_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(empty).count() == 0 and damage(empty).count() == 0
    one = spark.createDataFrame([(1, 0, "assistant", "Hi."), (2, 0, "user", "gone")], SCHEMA)
    got = {r.conv_id: r for r in repair_conversations(one, F.col("conv_id") == 1).collect()}
    assert (got[2].cost, got[2].audit, got[2].gaps, got[2].repaired) == (0, "", 0, [])
    assert [tuple(x) for x in got[1].repaired] == [("user", ""), ("assistant", "Hi.")] and got[1].audit == "IK"


# ---- URLs ----------------------------------------------------------------------

URLS = ["http://A.example.NET/en/5?x#y", "https://example.net/EN/5", "http://x.org/fr/a", "http://x.org/fr", "x.org/fr/a", None, "",
        "http://net", "http://net/", "http://b.example.com/de/1", "http://bexample.com/de/1", "ftp://q?a/b", "http://h#f/a", "a://b://c/d?e",
        "http://ünï.org/fr/é", "http://very.long/" + "a/" * 3000 + "z" * 20000]


def test_host_path_and_rules(spark):
    host, path = host_and_path(F.col("url"))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r.url: (r.h, r.p) for r in df.select("url", host.alias("h"), path.alias("p")).collect()}
    for u in URLS:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        h = re.match(r"[^/?#]*", rest).group()
        want = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in h), re.match(r"[^?#]*", rest[len(h):]).group())
        assert got[u] == want, u
    rules = {r.page_id: (r.rule, r.verdict) for r in filter_urls(df.selectExpr("*", "'z' as host", "1 as template", "2 as action")).collect()}
    assert len(rules) == len(URLS)
    assert rules[0] == ("example.net/en/", "allow") and rules[1] == ("net/", "block")
    assert rules[2] == ("org/fr/", "allow") and rules[3][0] is None and rules[4][0] is None and rules[5][0] is None
    assert rules[7][0] is None and rules[8] == ("net/", "block")
    assert rules[9] == ("example.com/de/", "block") and rules[10][0] is None
    assert {v for _, v in rules.values()} <= {"allow", "block"}


def site(spark):
    rows = [f"http://h.net/shop/{i}" for i in range(40)] + [f"http://h.net/en/{i}" for i in range(3)]
    rows += [f"http://a.org/fr/{w}" for w in "abcdefgh" for _ in range(9)]
    rows += [f"http://a.org/shop/{i}" for i in range(30)] + [f"http://a.org/blog/story-{chr(97 + i)}-{chr(98 + i)}" for i in range(20)]
    return spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumn("html", F.lit("x"))


def test_templates_generalise_and_reject(spark):
    got = {r.path: r for r in filter_urls(site(spark)).where("rule is null").collect()}
    assert got["/blog/story-a-b"].template == "/blog/*"  # each story is one page, the branch /blog holds twenty
    # unlabelled on its own host: the template's share over all hosts (40 of 40 blocked) decides
    assert got["/shop/3"].template == "/shop/0" and got["/shop/3"].verdict == "block" and got["/shop/3"].share > 0.9


def test_siblings_merge_only_when_alike(spark):
    rules = (("block", "s.com", "/x/bad"), ("allow", "s.com", "/x/good"), ("allow", "s.com", "/x/fine"))
    urls = [f"http://s.com/x/{w}" for w in ("bad", "good", "fine", "open") for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.path: r.verdict for r in filter_urls(df, rules).collect()}
    assert got == {"/x/bad": "block", "/x/good": "allow", "/x/fine": "allow", "/x/open": "allow"}


def test_no_labels_no_pages_and_no_python(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert filter_urls(none).count() == 0
    free = filter_urls(site(spark), rules=()).select("verdict", "share").distinct().collect()
    assert [tuple(r) for r in free] == [("allow", 0.5)]
    plan = path_templates(site(spark).selectExpr("page_id", "'h' as host", "'/a' as path", "'block' as action"))
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()


# ---- phrases -------------------------------------------------------------------


def mined(rows, least, top):
    grams, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, 5):
                grams[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = set()
    for lang, f in grams.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i:i + len(g)] == g for i in range(len(h))) for h, b in cand.items()):
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return out


def texts():
    rng = random.Random(5)
    words = ["new", "York", "Ünder", "été", "c++", "the", "of", "日本", "x\u00a0y"]
    rows = []
    for _ in range(90):
        body = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r"]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "de", None, "und"]), body + " New YORK\tcity hall "))
    rows += [("en", None), ("en", ""), ("fr", " .,\n"), (None, "the of " * 9000), ("en", "of the; " * 500), ("en", "of the; " * 500)]
    return rows


@pytest.mark.parametrize("mask", [(1 << 64) - 1, 0x3F])
def test_phrases_equal_brute_force_also_when_fingerprints_collide(spark, mask):
    rows = texts()
    df = spark.createDataFrame([(i // 2 if i % 9 else None, lang, text, 1, 2) for i, (lang, text) in enumerate(rows)],
                               "doc_id long, lang string, text string, f long, phrase int").repartition(6)
    got = collocations(df, min_count=10, top=40, mask=mask)
    assert {tuple(r) for r in got.drop("doc_id").collect()} == mined(rows, 10, 40)
    holders = {(r.lang, r.phrase): r.doc_id for r in got.collect()}
    assert holders["en", "of the"] is not None


def test_phrases_of_nothing(spark):
    assert collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0


# ---- neighbours of the order MinHash -------------------------------------------


def test_next_documents_of_distinct_ids_across_slices(spark):
    import math

    from quayline.llm.order_minhash import fingerprints_with_edit
    rng = random.Random(21)
    texts = {rng.randrange(-10**12, 10**12): " ".join(rng.choice("ab cd éf gh ij kl 日本".split()) for _ in range(rng.randrange(40)))
             for _ in range(700)}
    rows = [*texts.items(), (None, "no id here"), (5 * 10**12, None)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, _slice int, user string").repartition(7)
    got = {r.doc_id: r for r in fingerprints_with_edit(df).collect()}
    assert len(got) == len(rows)
    ids = sorted((d for d, _ in rows if d is not None), reverse=True)
    text = {d: t or "" for d, t in rows}
    for i, d in enumerate(ids):
        nxt = ids[(i + 1) % len(ids)]
        half = len(text[d]) // 2
        edited = text[d][:len(text[d]) - half] + text[nxt][:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), d
        a, b = ([f[j:j + 8] for j in range(0, len(f), 8)] for f in (got[d].fingerprint, got[nxt].fingerprint))
        same = sum(x == y for x, y in zip(a, b))
        assert abs(got[d].near_next - math.sqrt(same / max(len(a), len(b)))) < 1e-12
    assert got[None].near_next == 1.0


def test_line_counts_do_not_depend_on_ansi_mode(spark):
    from quayline.llm.line_dedup import drop_shared_lines
    line = "one line of more than twenty characters"
    df = spark.createDataFrame([(i, line if i < 3 else f"own {i}") for i in range(5)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for mode in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", mode)
            got = {r.doc_id: r.n_dropped for r in drop_shared_lines(df, min_chars=20, min_docs=3).collect()}
            assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}, mode
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
