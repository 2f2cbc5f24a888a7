"""Each operator against brute force on small tables with nulls, empty, long and repeated texts."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from inkstream.llm import chaining, common, compression, licenses, minhash, packing, perplexity, queries, sharding, tokens, warc, winnowing
from inkstream.llm.textcore import ALNUM_RE, SPACED_RE, fold
from pyspark.sql import functions as F

from .conftest import rows, words


def collected(df):
    return [r.asDict() for r in df.collect()]


# --- op7, op4


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_token_counts(docs, empty, library):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in collected(tokens.token_counts(docs, queries.vocabulary())))
    want = Counter()
    for i, t, *_ in rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 1024)] += 1
    assert got == want
    assert tokens.token_counts(empty, queries.vocabulary()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_counts_of_any_text(text):
    model = tokens.bpe(queries.vocabulary())
    ids = model.library.encode(text, add_special_tokens=False).ids
    assert model.ids(text).tolist() == ids and model.count(text) == len(ids)


def test_whole_tokens_are_proved(library):
    model = tokens.bpe(queries.vocabulary())
    some = list(model.whole)[::97]
    assert len(model.whole) > 20_000 and all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in some)


def test_counts_of_all_code_points():
    """Each code point but surrogates, within words, numbers and marks: counts, and so splits, are the library's."""
    model = tokens.bpe(queries.vocabulary())
    for base in range(0, 0x110000, 256):
        if 0x30000 < base < 0xE0000:
            continue
        text = "".join(f"a{chr(c)}b1{chr(c)}2!{chr(c)}? {chr(c)} " for c in range(base, base + 256) if not 0xD800 <= c <= 0xDFFF)
        if text:
            assert model.count(text) == len(model.library.encode(text, add_special_tokens=False).ids), hex(base)


def test_packing(docs, empty, library):
    got = collected(packing.pack_documents(docs, queries.vocabulary()))
    want = Counter()
    for i, t, *_ in rows():
        a = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(a) - 1) % 1024 + 1
        cuts = [0, *range(first, len(a) + 1, 1024)]
        for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, k, x, y - x, zlib.crc32(a[x:y]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    per = {}
    for r in got:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in per.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    bound = packing.lower_bound([r["length"] for r in got], 1024)
    assert bound <= len(per) <= bound + 1
    assert packing.pack_documents(empty, queries.vocabulary()).count() == 0


@settings(max_examples=100)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
def test_bounds_hold(lengths):
    """The bound never exceeds the optimum found by trying everything."""

    def optimum(rest, bins):
        if not rest:
            return len(bins)
        best = len(bins) + len(rest)
        for i, b in enumerate(bins):
            if b + rest[0] <= 20:
                best = min(best, optimum(rest[1:], [*bins[:i], b + rest[0], *bins[i + 1 :]]))
        return min(best, optimum(rest[1:], [*bins, rest[0]]))

    n = optimum(sorted(lengths, reverse=True), [])
    bins, offsets, closed, bound = packing.pack_part(np.array(lengths), 20)
    assert bound <= n <= bins.max() + 1 and len(offsets) == len(closed) == len(lengths)
    assert np.bincount(bins, lengths).max() <= 20


def test_exchange_between_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_PIECES", 40)
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 101, 400)]
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(df, 100).cache()
    assert Counter(r.doc_id for r in packed.collect()) == Counter(range(400))
    c = packing.certificate(packed, 100)
    assert c["bound"] <= c["sequences"] <= c["bound"] * 1.03
    assert packed.agg({"round": "max"}).first()[0] > 1


# --- op1


def test_archives(spark):
    big, other = "<p>" + "é" * 800, "<i>" * 400
    pages = [(1, "http://a/ b", big), (2, None, big), (3, "u", None), (4, "u", "small"), (5, "u", "small"), (6, "u\r\nX: y", other), (None, "u", other), (7, "u", big), (7, "u", big)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in collected(warc.round_trip(df)))
    want = Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        keeper = max((p for p, _, x in pages if x == h and p is not None), default=None) if len(b) >= 1000 else None
        again = keeper is not None and keeper != i
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", keeper if again else None)] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archive_files_round_trip(spark, tmp_path):
    pages = [(i, f"http://x/{i}", "<html>" + words(i, 120)) for i in range(60)] + [(-5, "u", "neg")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    scratch = common.Scratch(spark, "t")
    paths = warc.archive_files(warc.write_archives(warc.roles(df, scratch)), str(tmp_path)).collect()
    assert paths and open(paths[0].path, "rb").read(4) in (b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd")
    back = warc.read_files(spark, f"file://{tmp_path}").collect()
    assert {(r.page_id, bytes(r.payload).decode(), r.uri) for r in back} == {(i, h, u) for i, u, h in pages}


def test_dictionary_frame_and_bad_archives():
    w = warc.Writer()
    records = [warc.encode_record(i, "u", (words(i % 7, 60)).encode()) for i in range(100)]
    out = [a for r in records for a in w.add(r)] + list(w.end())
    a = b"".join(out)
    assert a[:4] == b"\x5d\x2a\x4d\x18" and list(warc.frames(a)) == records
    with pytest.raises(warc.WarcError):
        list(warc.frames(a[:-3]))
    good = records[0]
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"Content-Length: ", b"Content-Length: 1", 1), good + b"x", good.replace(b"WARC-Type: response", b"WARC-Type: other"), good[:-6] + b"zz" + good[-4:]):
        with pytest.raises(warc.WarcError):
            warc.decode_record(bad)


@given(st.integers(-(2**63), 2**63 - 1))
def test_ids_in_uuids(n):
    assert warc.page_of(warc.record_id(n)) == n and warc.page_of(warc.record_id(None)) is None


# --- op9


def test_shards(docs, empty):
    got = collected(sharding.kd_shards(docs, 4))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(0 <= r["shard"] < 4 and r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    assert sharding.kd_shards(empty, 4).count() == 0


def test_equal_rows_are_split(spark):
    df = spark.createDataFrame([(7, "same text", "s", "en")] * 600 + [(i, words(i, 20), "s", "en") for i in range(600)], "doc_id long, text string, source string, lang string")
    sizes = Counter()
    for r in collected(sharding.kd_shards(df, 6)):
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 6 and max(sizes.values()) - min(sizes.values()) < 400


def test_nodes_are_cut_at_medians_of_the_widest_dimension(spark):
    """All dimensions are as wide at first, so sizes are cut; then two sources far apart in dictionary order are."""
    df = spark.createDataFrame([(i, words(i, 10 + i // 2 % 90), "aaa" if i % 2 else "zzz", "en") for i in range(400)], "doc_id long, text string, source string, lang string")
    by, sources, sizes = Counter(), {}, {}
    for r in collected(sharding.kd_shards(df, 4).join(df.select("doc_id", "source"), "doc_id")):
        by[r["shard"]] += r["size"]
        sources.setdefault(r["shard"], Counter())[r["source"]] += r["size"]
        sizes.setdefault(r["shard"] // 2, []).append(r["size"])
    assert len(by) == 4 and max(by.values()) < 1.02 * min(by.values()) and max(sizes[0]) <= min(sizes[1])
    assert all(sources[i]["zzz"] < 0.1 * by[i] and sources[i + 1]["aaa"] < 0.1 * by[i + 1] for i in (0, 2))
    total = sum(by.values())
    assert {r["shard"] for r in collected(sharding.kd_shards(df, target_bytes=total // 5))} == set(range(5))


def test_equal_texts_lie_together(spark):
    df = spark.createDataFrame([(i, words(i // 8, 30), "s", "en") for i in range(640)], "doc_id long, text string, source string, lang string")
    where = {}
    for r in collected(sharding.kd_shards(df, 5)):
        where.setdefault(r["doc_id"] // 8, set()).add(r["shard"])
    assert sum(len(x) > 1 for x in where.values()) <= 4


# --- op10


def jaccard_components(k=5, percent=75):
    sets = []
    for i, t, *_ in rows():
        w = SPACED_RE.findall(fold(t or ""))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    out = Counter()
    for a, (i, s) in enumerate(sets):
        ids = [sets[b][0] for b in range(len(sets)) if find(b) == find(a) and sets[b][0] is not None] if s else [i]
        root = min(ids, default=None) if s else i
        out[(i, len(s), root, i == root)] += 1
    return out


def test_near_duplicates(docs, empty):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in collected(minhash.near_duplicates(docs)))
    assert got == jaccard_components()
    assert minhash.near_duplicates(empty).count() == 0


def test_chain_of_near_copies(spark):
    """Links that only neighbours have: the whole chain is one component, a far text is not."""
    base, texts = words(1, 200).split(), []
    for i in range(30):
        base = base.copy()
        base[(i * 61) % 200] = f"new{i}"
        texts.append((100 - i, " ".join(base)))
    df = spark.createDataFrame([*texts, (500, words(9, 200))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in collected(minhash.near_duplicates(df))}
    assert {v for k, v in got.items() if k != 500} == {71} and got[500] == 500


def test_prefix_pairs_are_complete(spark):
    rng = np.random.default_rng(3)
    core = rng.integers(1, 2**60, 60)
    data = [sorted({*rng.choice(core, int(rng.integers(35, 60)), replace=False).tolist(), *rng.integers(1, 2**60, int(rng.integers(0, 12))).tolist()}) for _ in range(60)]
    sets = spark.createDataFrame(list(enumerate(data)), "vertex long, shingles array<long>")
    vertices = spark.createDataFrame([(i, len(s), i % 50) for i, s in enumerate(data)], "vertex long, n long, c long")
    found = minhash.confirm(minhash.prefix_pairs(vertices, sets, 75, common.Scratch(spark, "t")), sets, 75)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 50 != b % 50 and 100 * len({*data[a]} & {*data[b]}) >= 75 * len({*data[a]} | {*data[b]})}
    assert {(r.a, r.b) for r in found.collect()} == want and want


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 2**63, 4000).astype(np.uint64))
    b = np.sort(np.r_[a[:3000], rng.integers(0, 2**63, 1000).astype(np.uint64)])
    assert abs((minhash.sketch(a) == minhash.sketch(b)).mean() - 0.6) < 0.15
    assert len(set(minhash.sketch(a[:1]).tolist())) == 1


# --- op5


def brute_contamination(docs, items, span=10):
    windows = []
    for i, t in items:
        w = ALNUM_RE.findall(fold(t or ""))
        windows += [(i, tuple(w[j : j + span])) for j in range(max(1, len(w) - span + 1))] if w else []
    for d, t in docs:
        w = ALNUM_RE.findall(fold(t or ""))
        hit, ids = set(), set()
        for i, x in windows:
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit.update(range(j, j + len(x)))
                    ids.add(i)
        ids.discard(None)
        yield d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, empty):
    base = words(50, 60).split()
    items = [(1, " ".join(base[:25])), (2, "short item here"), (30, " ".join(base[20:40])), (4, None), (5, ""), (6, "word"), (7, " ".join(base[40:50])), (7, " ".join(base[40:50])), (None, " ".join(base[50:60]))]
    texts = [" ".join(base), words(51, 40) + " " + " ".join(base[5:15]).upper() + " " + words(52, 9), " ".join(base[5:14]), "a SHORT item, here word", None, "", " ".join(base[48:60]), "word " * 30, " ".join(base[:10] * 3), words(53, 3000) + " " + " ".join(base[41:49])]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[0])]
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in collected(winnowing.decontaminate(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, around string"), spark.createDataFrame(items, "item_id long, text string"))))
    assert got == Counter(brute_contamination(docs, items))
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert winnowing.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), no_items).where("contaminated").count() == 0
    assert winnowing.decontaminate(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10_000))
def test_decontamination_of_few_words(spark, seed):
    r = np.random.default_rng(seed)
    text = lambda n: " ".join(r.choice(list("ab"), n))
    docs, items = [(i, text(int(r.integers(0, 60)))) for i in range(6)], [(i, text(int(r.integers(0, 16)))) for i in range(3)]
    got = Counter(tuple(x[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for x in collected(winnowing.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))))
    assert got == Counter(brute_contamination(docs, items))


# --- op6


def test_licences(spark, empty):
    mit = next(t for _, _, t in licenses.TEMPLATES if t.startswith("Permission is hereby"))
    worn = mit.replace("free of charge, ", "").replace("publish", "print")
    texts = ["The MIT License and CC-BY; apache  license GNU General Public License.", f"{words(1, 40)}\n{mit}\n{words(2, 20)}", worn, None, "", words(3, 200), "mit mit license license", "Licensed under CC BY-NC 4.0.", " ".join(mit.split()[:12])]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    out = collected(licenses.scan(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, template int")))
    assert len(out) == len(docs)
    for r in out:
        w = ALNUM_RE.findall(fold(texts[1 if r["doc_id"] is None else r["doc_id"]] or ""))
        places = [(j, label) for phrase, label in licenses.PHRASES for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split()]
        at = [j for j, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and {*filter(None, r["base_labels"].split(","))} <= {*r["labels"].split(",")} | {""}
    by = {r["doc_id"]: r for r in out}
    assert by[1]["labels"] == by[2]["labels"] == "mit" and by[1]["score"] == 1.0 and 0.6 <= by[2]["score"] < 1.0
    assert by[7]["labels"] == "cc-by,cc-by-nc" and by[5]["labels"] == by[8]["labels"] == "" and by[5]["score"] == 0
    assert licenses.scan(empty).count() == 0


def brute_labels(text):
    """By alignment without seeds, and names looked for in the text itself: blocks of equal words of each template and the text."""
    import difflib

    w = ALNUM_RE.findall(fold(text))
    grams_of = lambda t: {tuple(x[i : i + 3]) for x in [ALNUM_RE.findall(fold(t))] for i in range(len(x) - 2)}
    found = []
    for label, name, t in licenses.TEMPLATES:
        words, name = ALNUM_RE.findall(fold(t)), ALNUM_RE.findall(fold(name))
        blocks = [b for b in difflib.SequenceMatcher(None, w, words, autojunk=False).get_matching_blocks() if b.size >= 3]
        covered = {b.b + j for b in blocks for j in range(b.size)}
        others = set().union(*(grams_of(x) for other, _, x in licenses.TEMPLATES if other != label))
        own = {i + j for i in range(len(words) - 2) if tuple(words[i : i + 3]) not in others for j in range(3)}
        least = 0.6 if len(words) >= 10 else 1.0
        at = {b.a + j for b in blocks for j in range(b.size)}
        near = w[min(at) : max(at) + 1] if at else []
        named = not name or any(near[i : i + len(name)] == name for i in range(len(near)))
        if named and len(covered) >= least * len(words) and len(covered & own) >= least * len(own):
            found.append((len(covered), label, at))
    kept = []
    for n, label, at in sorted(found, key=lambda x: -x[0]):
        if all(2 * len(at & other) < min(len(at), len(other)) for _, _, other in kept):
            kept.append((n, label, at))
    return {label for _, label, _ in kept}


GPL = next(t for label, _, t in licenses.TEMPLATES if label == "gpl")


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (GPL.replace("GNU General", "GNU Lesser General"), {"lgpl"}),
        (GPL.replace("GNU General", "GNU Affero General"), {"agpl"}),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", {"cc-by-nc-nd"}),
        ("This work is licensed under the Creative Commons Attribution 3.0 Unported License. To view a copy of this license, visit the page.", {"cc-by"}),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", {"cc-by-sa"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. Some more words stand here.", {"mpl"}),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", {"epl"}),
        ("This work is dedicated to the public domain under CC0 1.0 Universal.", {"cc0"}),
        (GPL.replace("modify it under", "modify it as often as anybody may wish under"), {"gpl"}),
        ("The general public license of GNU is discussed in many a book on software that can be redistributed", set()),
        ("THIS SOFTWARE IS PROVIDED BY THE AUTHOR AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE AUTHOR OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)", {"bsd"}),
    ],
)
def test_labels_of_look_alikes(spark, text, labels):
    got = licenses.scan(spark.createDataFrame([(1, f"{words(1, 20)} {text} {words(2, 20)}")], "doc_id int, text string")).first()
    assert {*filter(None, got["labels"].split(","))} == labels


def test_labels_of_every_notice_and_of_prose(spark):
    """Each template, plain and with a word in twelve changed, has its own label alone; prose near a notice has none."""
    docs, want = [], {}
    for i, (label, _, text) in enumerate(licenses.TEMPLATES):
        w = text.split()
        docs.append((i, f"{words(i, 30)} {text} {words(100 + i, 30)}"))
        want[i] = {label}
        if len(w) >= 40:
            keep = {at + j for x in licenses.prepared() if x.label == label for at in x.names for j in range(x.name_words)}
            worn = " ".join(f"worn{j}" if j % 12 == 11 and "lic" not in x.lower() and "gnu" not in x.lower() and j not in keep else x for j, x in enumerate(w))
            docs.append((1000 + i, f"{words(200 + i, 30)} {worn} {words(300 + i, 30)}"))
            want[1000 + i] = {label}
    prose = ["Released under the Apache License", "The album was released under the title Blue Moon", "This work is licensed to the museum until 2030", "Permission is hereby granted to enter the garden", "an international license for drivers"]
    docs += [(2000 + i, t) for i, t in enumerate(prose)]
    want |= {2000 + i: {"apache"} if i == 0 else set() for i in range(len(prose))}
    got = {r["doc_id"]: {*filter(None, r["labels"].split(","))} - ({"cc-by"} if "CC BY-" in dict(docs)[r["doc_id"]] else set()) for r in collected(licenses.scan(spark.createDataFrame(docs, "doc_id int, text string")))}
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}
    assert all(brute_labels(dict(docs)[i]) == {x for x in want[i]} for i in want if i < 1000)


# --- op8


def test_repeated_passages(docs, empty):
    got = collected(chaining.repeated_passages(docs))
    assert {(r["doc_id"], r["source_doc_id"]) for r in got} >= {(1, 0), (2, 0), (4, 3)}
    assert all(r["doc_id"] not in (0, 3, 5, 6, 7, 8, 9, 10, 18) for r in got)
    four = next(r for r in got if r["doc_id"] == 4)
    assert abs(four["start"] - 30) <= 2 and abs(four["n_words"] - 70) <= 4 and abs(four["source_start"] - 80) <= 2
    two = next(r for r in got if r["doc_id"] == 2)
    assert (two["start"], two["n_words"]) == (0, 300) and two["n_matched"] == 297
    assert chaining.repeated_passages(empty).count() == 0


def test_every_exact_passage_is_found(spark):
    """Runs of 50 words that an earlier document has are covered, whatever surrounds them."""
    passages = [words(100 + i, 50 + 9 * i) for i in range(6)]
    texts = [(i, " ".join([words(i, 20 + i), passages[i % 6], words(900 + i, 15), passages[(i * 5 + 1) % 6], words(700 + i, 9)])) for i in range(40)]
    covered = {}
    for r in collected(chaining.repeated_passages(spark.createDataFrame(texts, "doc_id int, text string"))):
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    first = {}
    for i, t in texts:
        w = ALNUM_RE.findall(fold(t))
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) != i:
                assert set(range(j, j + 50)) <= covered[i]


def covered_words(spark, texts):
    out = {}
    for r in collected(chaining.repeated_passages(spark.createDataFrame(texts, "doc_id int, text string"))):
        out.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    return out


def every_window_is_covered(texts, covered, n=50):
    """By brute force: each window of n words that an earlier text has is covered."""
    first, missed = {}, []
    for i, t in sorted(texts):
        w = ALNUM_RE.findall(fold(t))
        missed += [(i, j) for j in range(len(w) - n + 1) if first.setdefault(tuple(w[j : j + n]), i) != i and not set(range(j, j + n)) <= covered.get(i, set())]
    return not missed


def test_phrases_of_other_documents_hide_no_passage(spark):
    """Ten earlier documents hold 12 words each of a passage of 60 that two later ones share."""
    passage = words(800, 60).split()
    texts = [(i, " ".join([words(810 + i, 60), *passage[5 * i : 5 * i + 12], words(830 + i, 60)])) for i in range(10)]
    texts += [(50, " ".join([words(850, 40), *passage, words(851, 40)])), (60, " ".join([words(852, 30), *passage, words(853, 30)]))]
    got = [(r["doc_id"], r["start"], r["n_words"], 50 in r["source_doc_ids"]) for r in collected(chaining.repeated_passages(spark.createDataFrame(texts, "doc_id int, text string")))]
    assert got == [(60, 30, 60, True)]


@settings(max_examples=6, deadline=None)
@example(223)
@given(st.integers(0, 10_000))
def test_passages_of_few_words(spark, seed):
    """Texts of 2 to 40 different words, with copied stretches: nothing that is repeated is missed."""
    r = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(int(r.integers(2, 40)))]
    lines = [r.choice(vocabulary, int(r.integers(5, 30))).tolist() for _ in range(12)]
    texts = [(i, " ".join(x for _ in range(int(r.integers(2, 9))) for x in lines[int(r.integers(12))])) for i in range(25)]
    assert every_window_is_covered(texts, covered_words(spark, texts))


def test_overlapping_anchors_leave_a_run_whole():
    """Anchors of two diagonals that overlap in the source, as of a passage whose first words also stand before it."""
    source = [*range(100, 107), *range(107, 157)]
    own = [*range(20), *source[:13], *range(30, 45), *source[7:], *range(60, 70)]
    at = own.index(107, 35)
    chains = [{"source": 1, "shift": 0, "words": source, "pos": [20, 26, *range(at, at + 44, 6)], "other": [0, 6, *range(7, 51, 6)]}]
    got = chaining.passages(np.array(own), chains)
    assert any(x["from"] <= at and x["to"] >= at + 50 for x in got)


def test_middle_of_a_long_gap_is_matched():
    """Words that agree between two long changed parts, without a seed of their own."""
    a = [*range(10), *range(1000, 1060), *[x if x % 5 else -x for x in range(20, 50)], *range(2000, 2060), *range(90, 100)]
    b = [*range(10), *range(3000, 3060), *range(20, 50), *range(4000, 4060), *range(90, 100)]
    runs = chaining.align(a, b, [0, 164], [0, 164])
    matched = {i + x for i, _, n in runs for x in range(n)}
    assert {i for i in range(70, 100) if a[i] == b[i]} <= matched and sum(n for *_, n in runs) == len(matched)


def test_chains_within_others_are_aligned():
    own = list(range(200))
    fuzzy = [w if w % 9 else -1 - w for w in own[:100]]
    chains = [{"source": 1, "shift": 0, "words": fuzzy, "pos": [10, 19, 28], "other": [10, 19, 28]}, {"source": 2, "shift": 0, "words": own[28:180], "pos": [28], "other": [0]}]
    got = chaining.passages(np.array(own), chains)
    assert [(x["from"], x["to"], x["sources"]) for x in got] == [(1, 180, {1, 2})]


@pytest.mark.parametrize("n", [9, 10, 11, 14, 17, 20])
def test_passages_of_one_repeated_line_are_whole(spark, n):
    line, times = words(300 + n, n), 160 // n
    texts = [(i, " ".join([words(40 + i, 30), *[line] * times, words(60 + i, 30)])) for i in range(3)]
    got = collected(chaining.repeated_passages(spark.createDataFrame(texts, "doc_id int, text string")))
    assert sorted((r["doc_id"], r["start"], r["n_words"]) for r in got) == [(1, 30, n * times), (2, 30, n * times)]


def test_fuzzy_passages_are_found(spark):
    """Passages of 50 to 60 words with 1 to 4 changed words, spread so that no long exact run is left."""
    texts, where = [], {}
    for i in range(80):
        n, changes = 50 + i % 11, 1 + i % 4
        passage = words(5000 + i, n).split()
        texts.append((i, " ".join([words(6000 + i, 30), *passage, words(7000 + i, 30)])))
        for c in range(changes):
            passage[(c + 1) * n // (changes + 1)] = f"changed{i}x{c}"
        texts.append((1000 + i, " ".join([words(8000 + i, 25), *passage, words(9000 + i, 25)])))
        where[1000 + i] = (25, n)
    got = {r["doc_id"]: (r["start"], r["n_words"]) for r in collected(chaining.repeated_passages(spark.createDataFrame(texts, "doc_id int, text string")))}
    missed = {d: (x, got.get(d)) for d, x in where.items() if d not in got or got[d][0] > x[0] or sum(got[d]) < sum(x)}
    assert not missed


def test_chains():
    assert chaining.chain([0, 10, 20, 30], [5, 15, 25, 35]) == [[0, 1, 2, 3]]
    parts = chaining.chain([0, 10, 20], [500, 10, 20])
    assert sorted(map(sorted, parts)) == [[0], [1, 2]]

    def brute(pos, other, k, gap):
        best = [float(k)] * len(pos)
        for i in sorted(range(len(pos)), key=lambda i: pos[i]):
            for j in range(len(pos)):
                if pos[j] < pos[i] and other[j] < other[i]:
                    best[i] = max(best[i], k + best[j] - gap * (pos[i] - pos[j] + other[i] - other[j]))
        return max(best)

    r = np.random.default_rng(2)
    for _ in range(30):
        pos, other = r.choice(100, 12, replace=False).tolist(), r.choice(100, 12, replace=False).tolist()
        top = chaining.chain(pos, other)[0]
        score = 6 * len(top) - 0.05 * (pos[top[-1]] - pos[top[0]] + other[top[-1]] - other[top[0]])
        assert abs(score - brute(pos, other, 6, 0.05)) < 1e-9


def test_cut_texts(docs):
    got = {(r["doc_id"], r["text"]) for r in collected(chaining.remove_repeats(docs)) if r["doc_id"] is not None}
    before = {(i, t) for i, t, *_ in rows()}
    texts = dict(got)
    assert texts[1] == "" and texts[0] == dict(before)[0] and texts[5] is None
    assert dict(before)[4].startswith(texts[4][:100]) and len(ALNUM_RE.findall(texts[4])) <= 124
    assert chaining.remove_repeats(docs).columns == docs.columns
    assert 1 not in {r["doc_id"] for r in collected(chaining.remove_repeats(docs, emptied=False))}
    assert chaining.without_spans("One, two! three.", [(1, 2)]) == "One, three." and chaining.without_spans("a b", [(0, 2)]) == ""


# --- op3


def test_word_statistics(docs, empty):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in collected(perplexity.quality_rules(docs)))
    want = Counter()
    for i, t, *_ in rows():
        t = t or ""
        w = SPACED_RE.findall(t)
        three = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        n, hit, seen, dup = Counter(three), set(), set(), 0
        for j, x in enumerate(three):
            if n[x] > 1:
                hit |= {j, j + 1, j + 2}
        for line in t.split("\n"):
            if SPACED_RE.search(line):
                dup += line in seen
                seen.add(line)
        want[(i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))] += 1
    assert got == want
    assert all(not (r["kept"] and r["base_failed"]) for r in collected(perplexity.quality_rules(docs)))
    assert perplexity.quality_rules(empty).count() == 0


def brute_models(rows):
    """Modified Kneser-Ney over text counts of 5-grams, in plain dictionaries; log perplexity of each row that passes."""
    def grams_of(t):
        s = " " * 4 + "".join(" " if c in " \t\n\v\f\r" else "0" if c in "0123456789" else c for c in t)
        return [s[i : i + 5] for i in range(len(s) - 4)]

    per = {}
    for _, t, lang in rows:
        per.setdefault(lang or "", Counter()).update(set(grams_of(t)))
    logp = {}
    for lang, top in per.items():
        levels, alone = {5: top}, {5: {g for g, v in top.items() if v == 1}}
        for m in (4, 3, 2, 1):
            levels[m] = Counter(g[1:] for g in levels[m + 1])
            alone[m] = {g[1:] for g in levels[m + 1] if levels[m][g[1:]] == 1 and g in alone[m + 1]}
        p = q = {"": 1 / (len(levels[1]) + 1)}
        for m in range(1, 6):
            c = levels[m]
            n = [0] + [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
            if n[1] and n[2] and n[3]:
                y = n[1] / (n[1] + 2 * n[2])
                d = [0] + [max(0.01, min(i - 0.01, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]
            else:
                d = [0, 0.5, 0.5, 0.5]
            total, rest = Counter(), Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                rest[g[:-1]] += d[min(v, 3)]
            left = {g: rest[g[:-1]] / total[g[:-1]] for g in c}
            seen = {g: left[g] * p[g[1:]] + (v - d[min(v, 3)]) / total[g[:-1]] for g, v in c.items()}
            p, q = seen, {g: seen[g] if g not in alone[m] else q[g[1:]] * (1 if total[g[:-1]] == 1 else left[g]) for g in c}
        logp[lang] = {g: np.log(q[g]) for g in top}
    return [-np.mean([logp[lang or ""][g] for g in grams_of(t)]) for _, t, lang in rows]


@pytest.mark.parametrize("shard", [1 << 22, 300])
def test_perplexity_is_kneser_ney(spark, monkeypatch, shard):
    """Scores, bands and verdicts against dictionaries, with one shard and with many."""
    monkeypatch.setattr(perplexity, "SHARD", shard)
    r = np.random.default_rng(5)
    cyrillic = [chr(c) for c in range(0x430, 0x450)]
    texts = [(i, " ".join("".join(r.choice(list("abcdeé"), int(r.integers(1, 5)))) for _ in range(80)) + f". {i}", "en") for i in range(25)]
    texts += [(100 + i, " ".join("".join(r.choice(cyrillic[:6], int(r.integers(1, 5)))) for _ in range(80)), None if i % 2 else "ru") for i in range(20)]
    texts += [(0, texts[0][1], "en"), (200, "".join(chr(0x4E00 + int(x)) + " " for x in r.integers(0, 3000, 90)), "ru")]
    got = {r["doc_id"]: r for r in collected(perplexity.quality_rules(spark.createDataFrame(texts, "doc_id long, text string, lang string")))}
    want = brute_models(texts)
    for (i, _, _), x in zip(texts, want, strict=True):
        assert abs(got[i]["log_perplexity"] - x) < 1e-4
    for lang in ("en", "ru", ""):
        bins = sorted(round(x * perplexity.BINS) for (_, _, y), x in zip(texts, want, strict=True) if (y or "") == lang)
        middle = np.median(bins)
        half = max(perplexity.LEAST, perplexity.WIDTH * 1.4826 * np.median(np.abs(np.array(bins) - middle)) / perplexity.BINS)
        for (i, t, y), x in zip(texts, want, strict=True):
            if (y or "") == lang:
                room = half + perplexity.SHORT / len(t) ** 0.5
                assert abs(got[i]["lower"] - (middle / perplexity.BINS - room)) < 0.01 and abs(got[i]["upper"] - (middle / perplexity.BINS + room)) < 0.01
                assert got[i]["kept"] == (got[i]["lower"] <= got[i]["log_perplexity"] <= got[i]["upper"])
    assert not got[200]["kept"]


def test_bands_reject_the_unlike(spark):
    """Symbol strings, and gibberish of the same non-Latin letters as the prose around it, leave the band."""
    r = np.random.default_rng(4)
    letters = [chr(c) for c in range(0x430, 0x450)]
    syllables = ["".join(r.choice(letters, 2)) for _ in range(40)]
    normal = [(i, words(i, 200), "en") for i in range(60)]
    normal += [(1000 + i, " ".join("".join(r.choice(syllables, int(r.integers(1, 4)))) for _ in range(200)), "ru") for i in range(60)]
    odd = [(100, " ".join(["zq7%Xw"] * 10 + [f"{i}#Q{i * 7}ZZ&J" for i in range(190)]), "en")]
    odd += [(2000, " ".join("".join(r.choice(letters, int(r.integers(2, 8)))) for _ in range(200)), "ru")]
    out = {r["doc_id"]: r["kept"] for r in collected(perplexity.quality_rules(spark.createDataFrame(normal + odd, "doc_id long, text string, lang string")))}
    assert not out[100] and not out[2000] and all(out[i] for i, _, _ in normal)


# --- op2


def test_classifier(docs, labels, empty):
    out = collected(compression.classify(docs, labels))
    assert len(out) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    same = {}
    for r in out:
        t = next(x[1] for x in rows() if x[0] == r["doc_id"])
        assert same.setdefault(t or "", r["score"]) == r["score"]
    assert {r["score"] for r in collected(compression.classify(docs, labels.limit(0)))} == {0.5}
    assert compression.classify(empty, labels).count() == 0 and compression.accepted(empty, labels).count() == 0


def test_scores_are_those_of_the_whole_tables(spark):
    """The dictionaries, the calibration and every score again without Spark, on a small table within the sample's bounds."""
    d, y = (queries.table(spark, "/root/testdata/sf0.01", x) for x in ("documents", "labels"))
    d = d.where("doc_id < 400")
    y = y.unionByName(y.where("doc_id = 3").withColumn("quality", 1 - F.col("quality")))  # an id with both labels is no evidence
    part = lambda i: zlib.crc32(str(i).encode()) % 4
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    seen = {}
    for r in y.collect():
        seen.setdefault(r.doc_id, set()).add(r.quality)
    label = {i: next(iter(v)) for i, v in seen.items() if len(v) == 1 and v <= {0, 1} and part(i) != 2}
    model = compression.Model(*(compression.dictionary([texts[i] for i in sorted(texts) if label.get(i) == c and part(i) != 3]) for c in (1, 0)))
    good, bad = compression.Sizer(*model.good), compression.Sizer(*model.bad)
    size = lambda c, t: sum(len(c.compressor.compress(t.encode()[i : i + 4096])) for i in range(0, len(t.encode()), 4096))
    x = {i: (size(bad, t) - size(good, t)) / max(1, len(t.encode())) for i, t in texts.items()}
    held = [i for i in sorted(texts) if i in label and part(i) == 3]
    model.calibrate(np.array([x[i] for i in held]), np.array([float(label[i]) for i in held]))
    every, rows_ = [label[i] for i in label if part(i) == 3], [label[i] for i in held]
    model.weights[0] += np.log(sum(every) / (len(every) - sum(every))) - np.log(sum(rows_) / (len(rows_) - sum(rows_)))
    got = {r["doc_id"]: r["score"] for r in collected(compression.classify(d, y))}
    assert len(got) == len(texts) and max(abs(got[i] - model.score(np.array([x[i]]))[0]) for i in texts) < 1e-9


def test_the_sample_is_bounded(spark, monkeypatch):
    """Whole rows up to so many bytes, also where one id has very many rows."""
    monkeypatch.setattr(compression, "FIT_BYTES", 5000)
    d = spark.createDataFrame([(1, words(i, 100)) for i in range(300)] + [(2, words(7, 3000))] + [(i, words(i, 50)) for i in range(3, 60)], "doc_id long, text string")
    y = spark.createDataFrame([(i, 1) for i in range(1, 60)], "doc_id long, quality int")
    rows_ = y.withColumnRenamed("quality", "y").withColumn("part", F.lit(0))
    got = compression.sampled(d, rows_, {(1, False): 4000}, common.Scratch(spark, "t"))[1, False].collect()
    assert got and sum(len(r.text.encode()) for r in got) <= 5000 and {r.text for r in got} <= {r.text for r in d.collect()}


def test_dictionaries_are_trained_on_every_sampled_text(monkeypatch):
    seen = []

    def train(size, pieces):
        seen.extend(pieces)
        raise compression.zstandard.ZstdError

    monkeypatch.setattr(compression.zstandard, "train_dictionary", train)
    texts = [f"{i:05d}" + "x" * 15_995 for i in range(1600)]
    compression.dictionary(texts)
    assert b"".join(seen) == "".join(texts).encode()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    d, y = queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels")
    r = compression.classify(d, y).where("held_out").join(y, "doc_id").select("predicted", "quality", "score").toPandas()
    assert (r.predicted == r.quality).mean() > 0.93
    good, bad = r[r.quality == 1].score.to_numpy(), r[r.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
