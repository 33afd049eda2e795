"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import itertools
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from treesift.llm import leaks, lookalike, mixture, pages, runs, topn

EVENTS = "frn long, usn long, reason long, ts timestamp, entity string, n int"


def runs_by_hand(events):
    seen = {}
    for frn, usn, reason, ts in events:
        if frn is not None and usn is not None:
            r = reason if reason is None else reason & ~0x80000000
            r = r if r is None or not r & 7 else r & ~7 | 1
            seen.setdefault(frn, {})[usn] = (r, ts)
    out = []
    for frn, found in seen.items():
        for _, run in itertools.groupby(sorted(found.items()), key=lambda e: e[1][0]):
            run = list(run)
            out.append((frn, run[0][0], run[-1][0], len(run)))
    return sorted(out)


@pytest.mark.parametrize(("seed", "blocks"), [(1, 64), (2, 3), (3, 7), (4, 2)])
def test_runs_match_brute_force_with_split_entities(spark, monkeypatch, seed, blocks):
    monkeypatch.setattr(runs.runtime, "hot_keys", (lambda f: lambda df, key, parts: f(df, key, parts, least=5))(runs.runtime.hot_keys))
    r = random.Random(seed)
    events = [(r.choice([None, 1, 1, 1, 1, 2, 3]), r.choice([None, *range(300)]), r.choice([None, 1, 2, 4, 0x80000002, 0x100, 0x100, 0x101]), None) for _ in range(400)]
    events = list({(f, u): (f, u, x, t) for f, u, x, t in events}.values())
    df = spark.createDataFrame([(*e, "clash", 1) for e in events + events[:50]], EVENTS)
    got = runs.collapse_runs(df, "frn", "usn", runs.canonical_reason(F.col("reason")), "ts", blocks)
    assert sorted((x["entity"], x["first_seq"], x["last_seq"], x["n"]) for x in got.collect()) == runs_by_hand(events)


def test_run_durations_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, 2, "2026-01-01 00:00:09"), (1, 2, 1, "2026-01-01 00:00:05"), (1, 3, 4, None), (2, 4, 1, None)], "frn long, usn long, reason long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = runs.collapse_runs(df, "frn", "usn", runs.canonical_reason(F.col("reason")), "ts").collect()
    assert sorted((x["n"], x["seconds"]) for x in got if x["entity"] == 1) == [(3, 4.0)] and [x["seconds"] for x in got if x["entity"] == 2] == [None]
    assert runs.collapse_runs(df.limit(0), "frn", "usn", F.col("reason")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_largest_rows(spark, seed):
    r = random.Random(seed)
    data = [(i, r.choice([None, 1, 1, 1, 2]), r.choice([None, *range(12)]), r.choice([None, "a", "B", "é", "b"]), r.choice([None, 5, 5, 7, 9]), 0) for i in range(120)]
    df = spark.createDataFrame(data, "row_id long, report long, id long, name string, size long, rank int")
    kept = {}
    for row in data:
        if row[4] is not None and ((row[1], row[2]) not in kept or kept[row[1], row[2]][0] > row[0]):
            kept[row[1], row[2]] = row
    want = []
    for g in {x[1] for x in kept.values()}:
        group = sorted((x for x in kept.values() if x[1] == g), key=lambda x: (-x[4], x[3] is not None, (x[3] or "").encode(), x[0]))
        want += [x[0] for x in group[:3]]
    got = topn.largest_rows(df, ["report", "id"], ["report"], "size", "name", "row_id", 3)
    assert sorted(x["row_id"] for x in got.collect()) == sorted(want)
    assert topn.largest_rows(df.limit(0), ["report", "id"], ["report"], "size", "name", "row_id", 3).count() == 0
    assert topn.top_n(df, ["report"], [F.col("row_id")], 0).count() == 0


ALIKE = [("ﬁle.txt", "file.txt"), ("a b", "a b"), ("ét", "ét"), ("re​port", "report"), ("x‐y", "x-y"), ("x−y", "x-y"), ("раypal", "paypal"), ("Ｆｕｌｌ", "Full"), ("ёx", "ëx"), ("ệ", "ệ"), ("e‍́", "é"), ("soft­ware", "software"), ("ɡo", "go"), ("①", "1"), ("Αβ", "Aβ")]
UNLIKE = [("l", "I"), ("O", "0"), ("a", "A"), ("é", "e"), ("rn", "m"), ("x–y", "x-y"), ("т", "t"), ("a  b", "a b"), ("ñ", "n"), ("会議", "会計"), ("ß", "ss")]


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(a, b):
    assert a != b and lookalike.skeleton(a) == lookalike.skeleton(b)


@pytest.mark.parametrize(("a", "b"), UNLIKE)
def test_unlike(a, b):
    assert lookalike.skeleton(a) != lookalike.skeleton(b)


def test_skeletons_are_fixed_points_and_keep_ascii():
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            s = lookalike.skeleton(chr(c))
            assert lookalike.skeleton(s) == s, hex(c)
    assert len({lookalike.skeleton(chr(c)) for c in range(128)}) == 128


@pytest.mark.parametrize("seed", range(3))
def test_pairs_match_brute_force(spark, seed):
    r = random.Random(seed)
    words = [w for pair in ALIKE + UNLIKE for w in pair] + ["", "plain", "long" * 5000 + "é", "long" * 5000 + "é"]
    data = [(i, r.choice([None, 1, 1, 1, 2]), r.choice([None, *words]), "clash", "x") for i in range(200)]
    df = spark.createDataFrame(data + data[:40] + [(None, 1, "ﬁle.txt", "", "")], "id long, parent long, name string, skeleton string, text string")
    members = lookalike.lookalike_members(df, "id", "parent", "name")
    got = sorted(tuple(x) for x in lookalike.lookalike_pairs(members).collect())
    shown = lambda t: lookalike.skeleton(t)
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(data, 2) if a[1] is not None and a[1] == b[1] and a[2] is not None and b[2] is not None and a[2] != b[2] and shown(a[2]) == shown(b[2]))
    assert got == want
    for row in members.collect():
        same = [x[2] for x in data if x[1] == row["scope"] and x[2] is not None and shown(x[2]) == shown(row["text"])]
        assert row["canonical"] == min(same, key=lambda t: t.encode())
    assert lookalike.lookalike_pairs(lookalike.lookalike_members(df.limit(0), "id", "parent", "name")).count() == 0


ITEMS = [
    (1, "Nadja hid 540 wool blankets at the quarry on market day and gave 696 of them to Mirek, said Mirek."), (2, "Can 147 silk ribbons outweigh chalk?"), (3, None), (4, ""), (5, "Petra counted 12 grams near Nadja, Mirek and Petra before the old lighthouse closed its doors at noon today."),
    (None, "Can 147 silk ribbons outweigh chalk?"), (2, "Can 147 silk ribbons outweigh chalk?"),
]


def leaks_by_hand(docs):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for (d, text, *_), (i, item) in itertools.product(docs, ITEMS):
        w = words(item)
        n = min(12, len(w))
        if d is not None and i is not None and n and grams(words(text), n) & grams(w, n):
            out.add((d, i))
    return sorted(out)


def test_leaks(spark):
    filler = "so the cache folder is not to blame here the order is given " * 30
    docs = [
        (1, "x " + ITEMS[0][1].upper().replace(" ", "\n--") + " y", "c"), (2, "hid 541 wool blankets at the quarry on market day and gave 697 of them", "c"), (3, "wool blankets at the quarry on market day and gave 696 of them_to", "c"), (4, "can 147 silk... ribbons; outweigh CHALK", "c"),
        (5, "can 148 silk ribbons outweigh chalk", "c"), (6, None, "c"), (7, "", "c"), (None, ITEMS[1][1], "c"), (8, filler + ITEMS[4][1] + filler, "c"), (8, filler, "c"), (9, "Can 147 silk ribbons", "c"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = leaks_by_hand(docs)
    assert {(1, 1), (3, 1), (4, 2), (8, 5)} <= set(want) and (2, 1) not in want
    for most in (10**6, 0):  # with the broadcast filter and without
        search = leaks.LeakSearch(items, "item_id", "text", most=most)
        assert sorted(tuple(x) for x in search.verbatim(df, "doc_id", "text").collect()) == want
        again = {(x["doc_id"], x["item_id"]) for x in search.reparameterised(df, "doc_id", "text").collect()}
        assert {(2, 1), (5, 2)} <= again and (9, 2) not in again
    none = leaks.LeakSearch(items.limit(0), "item_id", "text")
    assert none.verbatim(df, "doc_id", "text").count() == 0 and none.reparameterised(df, "doc_id", "text").count() == 0
    assert search.verbatim(df.limit(0), "doc_id", "text").count() == 0


def test_slots_must_be_consistent(spark):
    items = spark.createDataFrame([(1, "why did Nadja give 12 pears to Mirek while Nadja kept 12 plums here")], "id long, text string")
    docs = spark.createDataFrame([(1, "why did nadja give 30 pears to mirek while nadja kept 30 plums here"), (2, "why did nadja give 30 pears to mirek while nadja kept 31 plums here"), (3, "why did mirek give 12 pears to nadja while mirek kept 12 plums here")], "id long, text string")
    search = leaks.LeakSearch(items, "id", "text")
    assert sorted(x["doc_id"] for x in search.reparameterised(docs, "id", "text").collect()) == [1, 3]


def test_blocks_of_a_long_text_lose_no_window():
    text = " ".join(str(i) for i in range(1000))
    whole = {tuple(text.split()[i : i + 12]) for i in range(989)}
    assert {tuple(b[i : i + 12]) for b in leaks.word_blocks(text, block=50) for i in range(len(b) - 11)} == whole


def test_permutations_are_permutations():
    for n in (1, 2, 3, 10, 97, 1000):
        for key in (0, 1, 99):
            got = mixture.permute(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got) == list(range(n))
    both = mixture.permute(np.r_[np.arange(50), np.arange(70)], np.r_[np.full(50, 50), np.full(70, 70)], np.full(120, 5, np.uint64))
    assert sorted(both[:50]) == list(range(50)) and sorted(both[50:]) == list(range(70)) and list(both[:50]) != list(range(50))


def corpus(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "délta"]) for _ in range(r.choice([1, 5, 60, 300]))), r.choice(["big"] * 8 + ["small", "other", None])) for i in range(150)]
    docs += [(900, None, "big"), (901, "", "big"), (None, "x y z", "big"), (902, "word " * 20_000, "small")]
    targets = [("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2), ("zero", 0.0, 5)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_tokens_x", F.lit(1)), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mixture_keeps_shares_and_caps(spark):
    docs, df, targets = corpus(spark)
    draw, aimed = mixture.draw_mixture(df, targets, total_tokens=30_000, block_tokens=64, shard_blocks=50)
    rows = draw.collect()
    used = Counter((x["source"], x["doc_id"], x["first_token"]) for x in rows)
    assert all(n <= {"big": 1, "small": 3}[s] for (s, *_), n in used.items())
    blocks = Counter((x["source"], x["pass"], x["block"], x["shard"], x["slot"]) for x in rows)
    assert len({k[:3] for k in blocks}) == len(blocks) and len({k[3:] for k in blocks}) == len(blocks)
    shares = {x["source"]: x for x in mixture.mixture_shares(draw, targets, aimed * 64).collect()}
    assert abs(shares["small"]["share_of_aim"] - 0.4) < 0.01 and shares["none"]["tokens"] == shares["zero"]["tokens"] == 0
    held = mixture.count_tokens(df.where("source = 'big' and doc_id is not null").select("doc_id", "text"), "text").agg(F.sum("n_tokens")).first()[0]
    assert shares["big"]["tokens"] == min(held, round(0.5 * 30_000 / 64) * 64) or shares["big"]["tokens"] <= held
    again = mixture.draw_mixture(df, targets, total_tokens=30_000, block_tokens=64, shard_blocks=50)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_whole_source_drawn_once_covers_every_token(spark):
    _, df, _ = corpus(spark)
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    draw, _ = mixture.draw_mixture(df, targets, block_tokens=64)
    got = {x["doc_id"]: x["n"] for x in draw.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    want = {x["doc_id"]: x["n_tokens"] for x in mixture.count_tokens(df.where("source = 'big' and doc_id is not null").select("doc_id", "text"), "text").collect() if x["n_tokens"]}
    assert got == want


def test_mixture_of_nothing(spark):
    _, df, targets = corpus(spark)
    assert mixture.draw_mixture(df.limit(0), targets)[0].count() == 0
    assert mixture.draw_mixture(df, targets.limit(0))[0].count() == 0


@pytest.mark.parametrize(("blocks", "shard_blocks"), [(10**6, 1024), (10**10, 10**7)])
def test_plans_of_any_size_meet_quotas_at_random(spark, blocks, shard_blocks):
    quotas, aimed = mixture.source_quotas([("a", 0.7, 2), ("b", 0.3, 1), ("c", 0.0, 1)], {"a": blocks * 256, "b": blocks * 256, "c": 99}, blocks * 256, 256)
    assert aimed == blocks and {q[0]: q[1] for q in quotas} == {"a": blocks * 7 // 10, "b": blocks * 3 // 10, "c": 0}
    plans = [mixture.plan_draw(spark, quotas, shard_blocks, seed).orderBy("shard").collect() for seed in (1, 2, 1)]
    for plan in plans:
        drawn = Counter()
        for r in plan:
            assert r["first"] == drawn[r["source"]]
            drawn[r["source"]] += r["n"]
        assert drawn == {"a": blocks * 7 // 10, "b": blocks * 3 // 10}
    counts = [[r["n"] for r in p if r["source"] == "a"] for p in plans]
    assert counts[0] == counts[2] != counts[1]
    spread = np.std(counts[0]) / math.sqrt(shard_blocks * 0.7 * 0.3)
    assert 0.8 < spread < 1.2  # as a multinomial draw has


PROSE = "The index is rebuilt when the folder has been renamed, and the old names stay visible until the next scan of the volume has ended. You should check the parent links first, because an empty result does not mean that the table is ready. "
SPAM = {
    1: "garden hose cheap garden hose buy best garden hose sale garden hose online garden hose deal " * 4, 2: "\n".join(f"http://shop-{i}.example/item/{i * 37}" for i in range(12)), 3: "Tags: " + ", ".join(["roster", "planner", "rosters", "planner roster"] * 8),
    4: PROSE + "\n\n" + "hard drive top hard drive buy hard drive outlet hard drive sale coupon hard drive " * 10, 5: "\n".join(f'<a href="http://x{i}.example">buy lamp {i}</a>' for i in range(10)), 6: " ".join(f"#lamp{w} #deal #sale" for w in "abcdefgh"),
}
FINE = {
    11: PROSE * 3, 12: "Thanks, that worked.", 13: "See http://docs.example/a", 14: PROSE + "\nhttp://docs.example/a\nhttp://docs.example/b", 15: "```\n" + "[12] WARN rows: retry batch_leaf\n" * 30 + "```\n" + PROSE, 16: "    import os\n    import sys\n" * 10 + PROSE, 17: None, 18: "",
    19: PROSE + " Tags: index, scan, volume", 20: PROSE.lower().replace(".", "").replace(",", "") * 2, 21: "x" * 200_000,
}


def test_advertising(spark):
    docs = [(k, t, "en", "clash") for k, t in (SPAM | FINE).items()] + [(100 + i, PROSE[i % 40 :] + PROSE, "en", "") for i in range(60)] + [(None, SPAM[1], "en", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, words string")
    got = pages.advertising_pages(df, "doc_id", "text", "lang")
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(SPAM)
    assert pages.advertising_pages(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_blocks_hold_every_word():
    for text in (*SPAM.values(), *FINE.values()):
        plain = re.sub(r"</?(?:code|br)\s*/?>|^\s*```\s*$", " ", text or "", flags=re.M)
        assert sum(b[1] for b in pages.page_blocks(text)) == len(re.findall(r"[^\W_]+", plain))
    assert pages.page_blocks(unicodedata.normalize("NFD", PROSE))
    assert pd.DataFrame(pages.page_blocks(PROSE * 200))[1].max() < 2 * pages.BLOCK_WORDS


LINKS = [f"http://shop-{i}.example/item/{i * 37}" for i in range(12)]
IN_CODE = {
    31: "See my edit above.\n```\n" + "\n".join(LINKS) + "\n```", 32: "Thanks.\n~~~\n" + "\n".join(f"{i}. {x}" for i, x in enumerate(LINKS)) + "\n~~~", 33: "Thanks.\n<pre>" + "\n".join(LINKS) + "</pre>", 34: "Thanks.\n" + "\n".join("    - " + x for x in LINKS),
}
STILL_CODE = {
    41: "```\n" + "\n".join(f"curl -o out {x}" for x in LINKS) + "\n```", 42: "```\nurls = [\n" + "\n".join(f'    "{x}",' for x in LINKS) + "\n]\n```", 43: "```\n" + "\n".join(f"[12] WARN rows: retry {x}" for x in LINKS) + "\n```",
}


def test_bare_links_inside_code_count_as_links(spark):
    docs = [(k, t, "en") for k, t in (IN_CODE | STILL_CODE).items()] + [(100 + i, PROSE[i % 40 :] + PROSE, "en") for i in range(60)]
    got = pages.advertising_pages(spark.createDataFrame(docs, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(IN_CODE)
    for text in IN_CODE.values():
        assert sum(b[1] for b in pages.page_blocks(text)) == len(re.findall(r"[^\W_]+", text))


@pytest.mark.parametrize("most", [10**6, 0])
def test_names_that_no_item_has(spark, most):
    items = spark.createDataFrame([(1, "why did Nadja give 12 pears to Mirek while Nadja kept 12 plums here")], "id long, text string")
    texts = ["why did Ingrid give 12 pears to Mirek while Ingrid kept 12 plums here", "WHY DID INGRID GIVE 30 PEARS TO NADJA WHILE INGRID KEPT 30 PLUMS HERE", "why did ingrid give 12 pears to mirek while olaf kept 12 plums here", "why did 7 give 12 pears to mirek while 7 kept 12 plums here", "why did plums give 12 pears to mirek while plums kept 12 plums here"]
    search = leaks.LeakSearch(items, "id", "text", most=most)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert sorted(x["doc_id"] for x in search.reparameterised(docs, "id", "text").collect()) == [0, 1]
    assert search.verbatim(docs, "id", "text").count() == 0


def test_any_number_of_names(spark):
    name = lambda i: "Q" + "".join(chr(97 + int(c)) for c in f"{i:05}")
    rows = [(i, f"the guide told {name(i)} that") for i in range(10_001)] + [(20_000, "why did Qaaaab give 12 pears to Qaaaac while Qaaaab kept 12 plums here")]
    docs = spark.createDataFrame([(1, "why did Qaaaad give 12 pears to Qaaaae while Qaaaad kept 12 plums here")], "id long, text string")
    got = leaks.LeakSearch(spark.createDataFrame(rows, "id long, text string"), "id", "text").reparameterised(docs, "id", "text")
    assert [(x["doc_id"], x["item_id"]) for x in got.collect()] == [(1, 20_000)]


def test_compression_decides_about_pages(spark):
    docs = [(k, t, "en") for k, t in (SPAM | FINE).items()] + [(100 + i, PROSE[i % 40 :] + PROSE, "en") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = lambda **options: {x["doc_id"] for x in pages.advertising_pages(df, "doc_id", "text", "lang", **options).collect()}
    assert found(redundancy=0.0, in_sentences=0.0) == set()
    assert len(found(redundancy=1e9, in_sentences=1e9)) > len(SPAM)  # without the test every page counts
    repeats = spark.createDataFrame([(1, " ".join(f"{a} led lamp {b} led lamp {c}." for a in ("Our", "Get", "For") for b, c in itertools.permutations(("deal", "buy", "sale", "store"), 2)), "en"), (2, PROSE * 4, "en")], "doc_id long, text string, lang string")
    assert [x["doc_id"] for x in pages.advertising_pages(repeats, "doc_id", "text", "lang").collect()] == [1]
