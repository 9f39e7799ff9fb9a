"""Operators over replies and transcripts, on shapes made at random, against the rule in plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from tallymark.functions import udfs
from tallymark.operators import documents as D

TEXTS = ["", "plain", 'a "quoted" word', "back\\slash", "new\nline", "brace } here", "tab\tin", "é क", "[x]", "{", '"en": "trap"']


def clock(sec):
    return f"{sec // 60:02d}:{sec % 60:02d}"


def test_salvage_from_broken_replies(spark):
    """Whole {t, en} objects come out as they went in, wherever the reply breaks off."""
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        items = [{"t": clock(rnd.randrange(900)), "en": rnd.choice(TEXTS)} for _ in range(rnd.randrange(5))]
        space = rnd.choice([(", ", ": "), (",", ":"), (" ,\n ", " : ")])
        parts = [json.dumps(x, ensure_ascii=rnd.random() < 0.5, separators=space) for x in items]
        whole = '{"segments": [' + space[0].join(parts)
        cut = rnd.randrange(len(whole) + 1)
        ends, at = 0, len('{"segments": [')
        for p in parts:
            at += len(p)
            ends += at <= cut
            at += len(space[0])
        rows.append((i, whole[:cut], [(x["t"], x["en"]) for x in items[:ends]]))
    got = {r["i"]: [(s["t"], s["en"]) for s in r["s"]] for r in spark.createDataFrame([r[:2] for r in rows], "i int, reply string").select("i", D.salvaged(F.col("reply")).alias("s")).collect()}
    assert got == {i: want for i, _, want in rows} and sum(map(len, got.values())) > 100


def test_resumed_replies(spark):
    """Of each reply the segments later than the last one kept; a time that cannot be read counts as 0."""
    rnd = random.Random(2)

    def seconds(t):
        m = re.fullmatch(r"(\d+):(\d+)", t)
        return int(m[1]) * 60 + int(m[2]) if m else 0

    rows, want = [], {}
    for i in range(200):
        replies, at = [], 0
        for _ in range(rnd.randint(1, 4)):
            replies.append([(clock(max(0, at + rnd.randrange(-20, 40))) if rnd.random() < 0.9 else "??", f"s{rnd.randrange(99)}") for _ in range(rnd.randrange(4))])
            at += 30
        kept = []
        for reply in replies:
            last = seconds(kept[-1][0]) if kept else None
            kept += [s for s in reply if last is None or seconds(s[0]) > last]
        rows.append((i, replies))
        want[i] = kept
    df = spark.createDataFrame(rows, "i int, replies array<array<struct<t: string, en: string>>>")
    got = {r["i"]: [tuple(s) for s in r["kept"]] for r in df.select("i", D.resumed(F.col("replies")).alias("kept")).collect()}
    assert got == want


def test_alignment_of_replies(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        source = [(clock(rnd.randrange(300)),) for _ in range(rnd.randrange(8))]
        reply = [s if rnd.random() < 0.9 else ("99:99",) for s in source]
        reply = reply[: rnd.choice([len(reply), len(reply), max(0, len(reply) - 1)])]
        rows.append((i, source, reply))
    df = spark.createDataFrame(rows, "i int, a array<struct<t: string>>, b array<struct<t: string>>")
    for r in df.select("i", "a", "b", *[c.alias(n) for n, c in D.alignment(F.col("a"), F.col("b")).items()]).collect():
        a, b = [x["t"] for x in r["a"]], [x["t"] for x in r["b"]]
        assert r["aligned"] == (a == b)
        if r["aligned"] or not a:
            assert r["ask_again"] is None
        else:  # the parts cover the source once, none longer than half of it
            covered = [k for p in r["ask_again"] for k in range(p["first"], p["first"] + p["length"])]
            assert covered == list(range(len(a))) and all(0 < p["length"] <= max(1, len(a) // 2) for p in r["ask_again"])


def test_sections_of_texts(spark):
    """Sections put together at random come out as they went in, without what stands before, between and under other headings."""
    rnd = random.Random(4)
    rows, want = [], {}
    for i in range(200):
        text, found = rnd.choice(["", "intro\n", "# Top\nwords\n"]), []
        for _ in range(rnd.randrange(4)):
            name = rnd.choice(["Alpha", "Beta two", "Γ"])
            body = "\n".join(rnd.choice(["a line", "** not a mark", "#no heading", "[x]", "**Bold** text"]) for _ in range(rnd.randint(1, 3)))
            gap = rnd.choice(["\n", "\n\n", "\n\n\n\n\n"])
            text += f"**[{name}]**{gap}{body}"
            found.append((name, f"**[{name}]**{gap if gap != chr(10) * 5 else chr(10) * 2}{body}"))
            text += rnd.choice(["\n", "\n\n", "\n# Heading\nnot part\n", "\n\n### Deeper\nno\n", "\n**RULES HERE**\nno\n"])
        rows.append((i, text))
        want[i] = found
    got = {r["i"]: [tuple(s) for s in r["s"]] for r in spark.createDataFrame(rows, "i int, text string").select("i", D.sections(F.col("text")).alias("s")).collect()}
    assert got == want


def test_token_spans():
    """The tokens touched by the first occurrence, by looking at every character's token."""
    rnd = random.Random(5)
    for _ in range(500):
        tokens = ["".join(rnd.choice("ab c") for _ in range(rnd.randrange(4))) for _ in range(rnd.randrange(7))]
        part = "".join(rnd.choice("ab ") for _ in range(rnd.randrange(4)))
        text, owner = "".join(tokens), [k for k, t in enumerate(tokens) for _ in t]
        at = text.find(part)
        want = None if not part or at < 0 else (owner[at], owner[at + len(part) - 1])
        assert udfs.token_span(tokens, part) == want


def test_transcripts_of_any_shape(spark):
    """The same segments under every name and level that a transcript may have them."""
    rnd = random.Random(6)
    rows, want = [], {}
    for i in range(200):
        items, expected = [], []
        for _ in range(rnd.randint(1, 4)):
            sec, said, who = rnd.randrange(600), rnd.choice(["hello", "a: b", "क ख"]), rnd.choice([None, "A"])
            if rnd.random() < 0.2:
                items.append(said)
                expected.append((None, said))
                continue
            item = {rnd.choice(["t", "timestamp", "start"]): rnd.choice([clock(sec), sec, f"{sec}s"]), rnd.choice(["text", "native", "transcript"]): said}
            if who:
                item[rnd.choice(["speaker", "spk"])] = who
            items.append(item)
            expected.append((float(sec), f"{who}: {said}" if who else said))
        name = rnd.choice(["segments", "utterances", "transcript"])
        doc = {name: items}
        if rnd.random() < 0.4 and name != "transcript":
            doc = {"transcript": doc}
        rows.append((i, json.dumps(doc, ensure_ascii=False)))
        want[i] = expected
    got = {r["i"]: [(s["t_sec"], s["text"]) for s in r["s"]] for r in spark.createDataFrame(rows, "i int, raw string").select("i", D.polymorphic_segments(F.col("raw")).alias("s")).collect()}
    assert got == want
