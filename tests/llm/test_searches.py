"""Decontamination, license scans and quotation linking."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from marlspike.llm import decontamination, license_scan, quotations

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def benchmark(spark, prose_of):
    return spark.createDataFrame([(i, prose_of(20 + 3 * i, 40 + i, 5)) for i in range(8)] + [(90, None), (91, ""), (92, "...")], "item_id long, text string")


def test_finds_passages_and_paraphrases(spark, prose_of, benchmark):
    items = {r["item_id"]: r["text"] for r in benchmark.collect() if r["item_id"] < 8}
    docs = [(i, prose_of(150, i)) for i in range(20)]
    docs += [(100 + i, prose_of(70, i) + "\n" + t.upper() + ", " + prose_of(90, i + 3)) for i, t in items.items()]
    for i, t in items.items():
        words = t.split()
        words[1 : len(words) // 2 : 4] = ["other"] * len(words[1 : len(words) // 2 : 4])
        docs.append((200 + i, prose_of(30, i) + " " + " ".join(words) + " " + prose_of(30, i)))
    docs += [(300, None), (301, ""), (302, "x")]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert {(100 + i, i) for i in items} | {(200 + i, i) for i in items} <= got
    assert all(d >= 100 for d, _ in got)


def test_finds_more_items_than_the_space_has_directions(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=6)) for _ in range(4000)]
    items = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(600)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=48)) + " " + t + " " + " ".join(rng.choices(vocabulary, k=50))) for i, t in enumerate(items)]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i in range(600)}


def test_windows_do_not_depend_on_the_documents_around():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=6)) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, prose(12)) for i in range(40)]
    docs = [f"{t} {prose(30)}" for _, t in items]
    idf = decontamination.weights(np.zeros(decontamination.TERMS), 100)
    space = decontamination.covering(np.zeros((decontamination.TERMS + 1, 0), np.float32), idf, [t for _, t in items])
    searcher = decontamination.Searcher(*decontamination.compared(items, idf, space), idf)
    scan = lambda texts: [(f[0], f[1], *f[3:]) + (round(f[2], 4),) for f in searcher.scan(texts)]
    alone = [f[1:] for d in docs for f in scan([d])]
    assert {(f[0], f[1]) for i, d in enumerate(docs) for f in searcher.search([d]) if f[1] == i} == {(0, i) for i in range(40)}
    for before in (1, 9, 17, 25, 9000):
        texts = [x for d in docs for x in (prose(before), d)]
        among = [f[1:] for f in scan(texts) if f[0] % 2]
        assert sorted(among) == sorted(alone)


def test_recall_against_exhaustive_search(spark):
    """Items of 3 to 60 words, verbatim and with words changed or put in, against subsequences of all windows; and one partition against seven."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=6)) for _ in range(3000)]
    words = lambda n: rng.choices(vocabulary, k=n)
    items = [words(n) for n in (3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 24, 30, 40, 50, 60) for _ in range(8)]
    docs = []
    for i, item in enumerate(items):
        changed = [rng.choice(vocabulary) if rng.random() < 0.25 else w for w in item]
        longer = [x for w in item for x in ([w, rng.choice(vocabulary)] if rng.random() < 0.2 else [w])]
        docs += [words(rng.randrange(0, 200)) + own + words(rng.randrange(0, 200)) for own in (item, changed, longer)]
        docs.append(words(300))
    expected = set()
    for k, doc in enumerate(docs):
        held = set(doc)
        for i, item in enumerate(items):
            if len(held & set(item)) * 2 >= len(item):
                checked = decontamination.Item(i, " ".join(item))
                n = len(item) + len(item) // 4
                if any(decontamination.contained(*checked.check(doc[a : a + n])) for a in range(max(1, len(doc) - n + 1))):
                    expected.add((k, i))
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    one, seven = ({(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df.repartition(n), benchmark).collect()} for n in (1, 7))
    assert one == seven
    assert {(4 * i, i) for i in range(len(items))} <= one
    assert len(one & expected) >= 0.95 * len(expected)
    for low, high in ((3, 6), (7, 15), (16, 60)):
        own = {(k, i) for k, i in expected if low <= len(items[i]) <= high}
        assert len(one & own) >= 0.95 * len(own), (low, high, len(one & own), len(own))


def test_terms_are_those_of_bare_tokens(monkeypatch):
    """One bucket for each bare token, wherever it stands, in long texts too."""
    texts = [None, "", "  ", "The (cat), the-cat _x_ ... ÉTÉ été\x1cend\u2003x!", "the", "\ud800 a", "日本 ¿que? 🙂"]
    ids, counts = decontamination.token_terms(texts)
    tokens = [t for x in texts for t in (x or "").lower().split()]
    assert counts.tolist() == [len((x or "").lower().split()) for x in texts] and len(ids) == len(tokens)
    known = {}
    for token, i in zip(tokens, ids.tolist(), strict=True):
        word = decontamination.bare(token)
        assert (i == decontamination.TERMS) == (word == "") and known.setdefault(word, i) == i
    many = [f"{a}{b}" for a in "abcdefghij" for b in range(100)]
    assert len(set(decontamination.token_terms([" ".join(many)])[0].tolist())) > 900
    long = " ".join(random.Random(1).choices(tokens, k=900))
    whole = decontamination.token_terms([long])[0].tolist()
    monkeypatch.setattr(decontamination, "CHUNK", 50)
    assert decontamination.token_terms([long])[0].tolist() == whole == [known[decontamination.bare(t)] for t in long.split()]


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    a, b = "abcbdabxyzab", "bdcabaxzab"
    assert decontamination.lcs(decontamination.masks_of(list(a)), len(a), list(b)) == slow(a, b)


def test_decontamination_edges(awkward, empty, benchmark):
    assert decontamination.contaminated(awkward, benchmark).count() == 0
    assert decontamination.without_contaminated(awkward, benchmark).count() == 8
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.contaminated(awkward, benchmark.limit(0)).count() == 0


def license_brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words, starts, labels = WORD.findall(low), [], set()
    for phrase, label in license_scan.BASE:
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    norm = " " + " ".join(words) + " "
    found = [(m.start(), -m.end(), -r["priority"], r["place"], r["label"], r["sure"]) for r in license_scan.rules() for m in re.finditer(r["pattern"], norm)]
    kept = [d for d in found if not any(e != d and e[2] <= d[2] and e[0] <= d[0] and e[1] <= d[1] and (e[:3] != d[:3] or e < d) for e in found)]
    score = max([d[5] for d in kept] + [0.8 if starts else 0.0])
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {d[4] for d in kept})), score


def test_licenses_against_brute_force(spark, awkward, empty):
    texts = [None, "", "CC BY cc by cc-by-nc 4.0 All rights reserved", "éé GNU General, Public LICENSE version 2 or later; see SPDX-License-Identifier: Apache-2.0 x", "Licensed under the Apache License, Version 2.0. " * 30, "cc\nby ccby all rights  reserved all rights reserved", "This work is licensed under CC BY-NC-SA 4.0 and the MIT License. Public Domain", "Permission is hereby granted, free of charge, to any person obtaining a copy of x WITHOUT WARRANTY no warranties Copyright (c) 2020 me", "plain words only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan_licenses(df).drop("places").collect():
        assert tuple(r)[1:] == license_brute(texts[r["doc_id"]])
    assert len(license_scan.rules()) > 200
    assert license_scan.scan_licenses(awkward).count() == 8 and license_scan.scan_licenses(empty).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""


def test_whole_license_texts(spark):
    texts = {"mit": MIT, "isc": ISC, "bsd": BSD}
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert all(label in got[label] for label in texts)


def test_names_without_the_word_license_against_brute_force(spark):
    texts = ["Distributed under the GPL version 2", "released under the MIT.", "under the terms of the GPLv3", "covered by the MPL 2.0", "Copyright 2020 me. Published under\nthe-BSD 2-clause", "subject to Expat", "made in\taccordance with: the terms and conditions of the ZLIB", "understood by limits"]
    texts += [f"{verb} the {min(license_scan.spelled(name)[0])}" for verb in ("Available under", "covered by") for _, name in license_scan.NAMES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in license_scan.scan_licenses(df).drop("places").collect()]
    assert [r[1:] for r in sorted(got)] == [license_brute(t) for t in texts]
    assert sorted(got)[1][6:] == ("mit", 0.95)


def test_many_places_in_one_text(spark):
    """A text of license lines alone takes time in proportion to its length."""
    import time

    lines = lambda n: "Copyright 2020 all rights reserved x\n" * n
    took = []
    for n in (300, 300, 30_000):
        df = spark.createDataFrame([(1, lines(n))], "doc_id long, text string")
        began = time.time()
        (row,) = license_scan.scan_licenses(df).collect()
        took.append(time.time() - began)
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (6 * n, n, 2, 6 * n - 4)
        assert [tuple(p)[:3] for p in row["places"][-2:]] == [(6 * n - 6, 6 * n - 4, "copyright"), (6 * n - 4, 6 * n - 1, "reserved")] and len(row["places"]) == 2 * n
    assert took[2] < took[1] + 20


def test_license_scan_is_native(awkward):
    plan = license_scan.scan_licenses(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Where is the red book?\nIt was on the table."),
        (1, 1, "assistant", "On Monday, A wrote:\n> Where is the red  book?\n\nIn the kitchen."),
        (1, 2, "user", "> > Where is the RED book?\n> In the kitchen.\nThanks!"),
        (1, 3, "user", "> not said by anyone\nHm."),
        (2, 0, "user", "> In the kitchen.\nother conversation"),
        (2, 1, "user", None),
        (2, 1, "user", ""),
        (None, 0, "user", "In the kitchen."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(((r["conv_id"], r["turn"], r["clean"], r["n_quotes"], r["max_level"], r["n_linked"], r["reply_to"]) for r in quotations.link_quotations(df).collect()), key=str)
    assert got == sorted([(1, 0, rows[0][3], 0, 0, 0, None), (1, 1, "In the kitchen.", 1, 1, 1, 0), (1, 2, "Thanks!", 2, 2, 2, 1), (1, 3, "Hm.", 1, 1, 0, None), (2, 0, "other conversation", 1, 1, 0, None), (2, 1, "", 0, 0, 0, None), (2, 1, "", 0, 0, 0, None), (None, 0, "In the kitchen.", 0, 0, 0, None)], key=str)
    assert quotations.link_quotations(df.limit(0)).count() == 0
    assert [(r["thread"], r["turn"], r["depth"]) for r in quotations.conversations(quotations.link_quotations(df)).filter("conv_id = 1").collect()] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (3, 3, 0)]


def quotation_brute(rows):
    """{(conv_id, turn): (reply_to, thread, depth)}, by comparing every passage with every earlier message."""
    parsed = {(c, t): quotations.parse(text) for c, t, _, text in rows}
    reply = {}
    for (c, t), (_, quotes, _) in parsed.items():
        linked = []
        for at, q in enumerate(quotes):
            words = {}
            for unit in q["units"]:
                has = [s for (d, s), (own, _, _) in parsed.items() if d == c and unit["h"] in {u["h"] for u in own}]
                if has and min(has) < t:
                    words[min(has)] = words.get(min(has), 0) + unit["words"]
            if words:
                linked.append((-q["level"], at, max(words, key=lambda s: (words[s], s))))
        reply[c, t] = max(linked)[2] if linked else None
    out = {}
    for c, t in parsed:
        root, depth = t, 0
        while reply[c, root] is not None:
            root, depth = reply[c, root], depth + 1
        out[c, t] = reply[c, t], root, depth
    return out


def test_quotations_against_brute_force(spark, prose_of):
    """Chains and branches of answers; quotations whole, wrapped anew, cut, nested and of several messages."""
    rng = random.Random(8)
    rows = []
    for c in range(6):
        own = []
        for t in range(14):
            words = prose_of(rng.choice([6, 20, 45]), rng.randrange(500)).split()
            text = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
            quotes = []
            for _ in range(rng.choice([0, 1, 1, 2]) if own else 0):
                said = rng.choice(own[-4:]).split()
                width = rng.choice([4, 9, 30])
                cut = said[rng.choice([0, 0, 5]) :] or said
                quotes += [f"{'> ' * rng.choice([1, 1, 2])}{' '.join(cut[i : i + width])}" for i in range(0, len(cut), width)] + ["", "ok"]
            rows.append((c, t, "user", "\n".join([*quotes, text])))
            own.append(text)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["depth"]) for r in quotations.link_quotations(df).collect()}
    assert got == quotation_brute(rows)
    assert max(x[2] for x in got.values()) > 3 and sum(x[0] is not None for x in got.values()) > 40


def test_quotation_wrapped_anew(spark):
    text = "The quick brown fox jumps over the lazy dog while nine\nother animals watch it from behind the tall green hedge."
    anew = "> The quick brown fox jumps over\n> the lazy dog while nine other animals watch\n> it from behind the tall green hedge.\nYes."
    df = spark.createDataFrame([(1, 0, "a", text), (1, 1, "b", anew), (None, 2, "b", anew)], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["clean"]) for r in quotations.link_quotations(df).collect()}
    assert got == {(1, 0): (None, text), (1, 1): (0, "Yes."), (None, 2): (None, "Yes.")}


def test_every_window_of_a_quotation_links(spark):
    """Quotations of eight words out of a longer line, from every place of it: each of them is one window."""
    said = [f"word{i}" for i in range(40)]
    rows = [(c, 0, "a", " ".join(said)) for c in range(33)] + [(c, 1, "b", f"> {' '.join(said[c : c + 8])}\nyes") for c in range(33)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["reply_to"] for r in quotations.link_quotations(df).filter("turn = 1").collect()}
    assert got == dict.fromkeys(range(33), 0)


def test_space_is_fitted_on_every_document(spark):
    """The strongest directions of 2,500 documents, more than DOCUMENTS, are those of a whole decomposition."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=6)) for _ in range(400)]
    topics = [rng.sample(vocabulary, 30) for _ in range(12)]
    texts = [" ".join(rng.choices(rng.choice(topics), k=40)) for _ in range(2500)] + [None, "", "..."]
    rows = decontamination.term_rows(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    df, n = decontamination.document_frequencies(rows)
    assert n == len(texts)
    idf = decontamination.weights(df, n)
    matrix = np.zeros((n, decontamination.TERMS))
    for row, text in zip(matrix, texts, strict=True):
        np.add.at(row, decontamination.known_terms(text), 1)
    assert (df == (matrix > 0).sum(0)).all()
    matrix *= idf[:-1]
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    exact = matrix[:, matrix.any(0)]
    values = np.linalg.eigvalsh(exact.T @ exact)[::-1][:12]
    got = decontamination.strongest_directions(rows, idf, n).astype(np.float64)
    weight = decontamination.DOCUMENT_WEIGHT**2 * decontamination.DOCUMENTS / n
    assert np.allclose(np.sort((got**2).sum(1))[::-1][:12], values * weight, rtol=0.01)


def test_rows_are_multiplied_one_by_one_only_where_that_takes_less_time(monkeypatch):
    """Projections and products of entries() are those of every row alone; the last pass makes no product of the size of the basis."""
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(400, n, replace=False)).astype(np.uint16), rng.integers(1, 5, n).astype(np.int32)) for n in (1, 30, 0, 200, 7) * 9]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[k].tobytes() for x in part], pa.binary()) for k in (0, 1)], names=["terms", "often"]) for part in (rows[:13], rows[13:])]
    idf = decontamination.weights(rng.integers(1, 45, decontamination.TERMS), 45)
    basis = decontamination.random_basis(8)
    expected = np.zeros_like(basis)
    for at, count in rows:
        if len(at):
            decontamination.add_product(expected, basis, idf, at.astype(np.intp), count.astype(np.float32))
    monkeypatch.setattr(decontamination, "ENTRIES", 700)
    for frequent, block in ((np.arange(0), 64), (np.arange(0, 400, 3), 600), (np.arange(decontamination.TERMS), 1 << 16)):
        monkeypatch.setattr(decontamination, "BLOCK", block)
        projector, total, gram, parts = decontamination.Projector(basis, frequent), np.zeros_like(basis), 0, 0
        for own in decontamination.entries(batches, idf):
            projected = projector.project(*own, total)
            assert np.allclose(projected, projector.project(*own), atol=1e-5)
            gram, parts = gram + projected.T @ projected, parts + 1
        assert parts > 1 and np.allclose(total, expected, atol=1e-5) and np.allclose(gram, basis.T @ expected, atol=1e-5)


def test_long_runs_of_marks_around_words():
    bare = decontamination.token_terms(["word other a-b"])[0].tolist()
    for n in (1, decontamination.MARKS, decontamination.MARKS + 1, 50):
        x = "-" * n
        ids, counts = decontamination.token_terms([f"{x}word{x} {x}", f"other{x}", None, x, f"{x}a-b {x}{x}"])
        assert ids.tolist() == [bare[0], decontamination.TERMS, bare[1], decontamination.TERMS, bare[2], decontamination.TERMS] and counts.tolist() == [2, 1, 0, 1, 2]


def test_spaces_of_items_take_little_memory():
    """The driver has no second copy of the items' rows, nor any in double precision; directions are those of a whole decomposition."""
    import tracemalloc

    rng = np.random.default_rng(4)
    few = np.zeros((decontamination.TERMS, 6), np.float32)
    few[:900, :4] = rng.standard_normal((900, 4)) * [1, 1e-3, 30, 5]
    few[:, 4] = few[:, 2] * 2
    u, s, _ = np.linalg.svd(few.astype(np.float64), full_matrices=False)
    got = decontamination.orthonormal(few.copy())
    assert np.allclose(np.abs(u[:, :4].T @ got[:, :4]), np.eye(4), atol=1e-4) and not got[:, 4:].any()
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnop"), (4000, 6))]
    items = [(i, " ".join(rng.choice(words, 30))) for i in range(300)]
    texts, idf = [t for _, t in items], decontamination.weights(rng.integers(1, 90, decontamination.TERMS), 100)
    directions = rng.standard_normal((144, decontamination.TERMS), np.float32) * 0.001
    decontamination.random_basis(decontamination.RANK)
    tracemalloc.start()
    space = decontamination.latent_space(texts, directions, idf)
    latent, _ = tracemalloc.get_traced_memory()[1], tracemalloc.reset_peak()
    space = decontamination.covering(space, idf, texts)
    cover = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert latent < 55e6 and cover < 75e6, (latent, cover)
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-3)
    for text in texts:
        row = np.bincount(decontamination.known_terms(text), minlength=decontamination.TERMS + 1) * idf
        assert np.linalg.norm(row @ space) >= decontamination.KEEP * np.linalg.norm(row) * 0.999
