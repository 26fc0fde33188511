import re

import pytest

from lumenloom.llm import language_id as L
from lumenloom.llm.license_scan import TEMPLATES, license_scan
from lumenloom.llm.mixing import mix, repeat_rows
from lumenloom.llm.quality import keep_good, quality_verdicts
from lumenloom.llm.warc import read_warc, write_warc
from lumenloom.scratch import new_path


def test_quality(spark, hard, empty):
    got = quality_verdicts(hard).collect()
    for r, s in zip(sorted(got, key=lambda r: (r.doc_id or -1)), sorted(hard.collect(), key=lambda r: (r.doc_id or -1)), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", s.text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(3)} if len(words) < 100 else set(range(len(words)))
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.kept and r.base_failed)
    assert quality_verdicts(empty).count() == 0 and keep_good(empty).columns == empty.columns


def test_quality_rejects_what_stands_out(spark):
    good = [(k, " ".join(f"w{k}x{i}" for i in range(80)), "en", "a") for k in range(300)]
    bad = [(1000 + k, " ".join(f"w{k}x{i}###" for i in range(80)), "en", "a") for k in range(20)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in keep_good(df).collect()) == list(range(300))


def test_licenses(spark, hard, empty):
    lines = [(100 + k, f"some text\n{t.upper()} and more\nend", label) for k, (label, t) in enumerate(TEMPLATES)] + [(200, "CC BY here, cc-by\nall rights\nreserved", ""), (201, "licensed under nothing", "")]
    df = spark.createDataFrame([(i, t) for i, t, _ in lines], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(df).collect()}
    for i, _, label in lines:
        assert not label or label in got[i].labels.split(",")
    assert (got[200].n_base, got[200].first_word, got[200].last_word, got[200].base_labels) == (3, 0, 5, "cc-by,reserved")
    assert (got[201].labels, got[201].score, got[201].first_word) == ("", 0.0, None)
    assert license_scan(hard).count() == hard.count() and license_scan(empty).count() == 0


def test_wrapped_licenses(spark):
    """Notices as published, over several lines, and a split at every word; far-off words of two texts or paragraphs are no notice."""
    mit = "The MIT License (MIT)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "# Redistribution and use in source and binary forms, with or without\r\n# modification, are permitted provided that the following conditions are\r\n# met:"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed */"
    rows = [(1, mit, "mit"), (2, bsd, "bsd"), (3, mpl, "mpl-2.0"), (4, "one\nword a\nline " + mit.replace(" ", "\n"), "mit"), (5, "Released under\n" + "other words " * 9 + "\nthe MIT License", "")]
    named = "Redistribution and use in source and binary forms of the Some Holder\nprogram, with or without modification, are permitted by Some\nHolder provided that the following conditions are met"
    rows += [(8, named, "bsd"), (9, named.replace("\n", " "), "bsd"), (10, "conditions following the that provided permitted are\nmodification, without or with forms binary and source in use and redistribution", "bsd")]
    rows += [(6, "Redistribution and use in source and binary forms, with or", ""), (7, "without modification, are permitted provided that the following conditions are met", "")]
    parts = TEMPLATES[4][1].split()
    rows += [(100 + k, "before " * k + " ".join(parts[:k]) + "\n" + " ".join(parts[k:]), "bsd") for k in range(1, len(parts))]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)).collect()}
    for i, _, label in rows:
        assert got[i].labels == label, i
    assert all(got[i].score == 1.0 for i in got if i >= 100 or i < 5 or i in (8, 9)) and got[5].score == 0


def test_containment_join_finds_all(spark):
    """Against a plain comparison of every block with every template."""
    import random

    rng = random.Random(4)
    templates = [(f"t{k}", " ".join(rng.sample([f"v{i}" for i in range(40)], rng.randint(3, 12)))) for k in range(8)]
    docs = [(i, "\n".join(" ".join(rng.choices([f"v{i}" for i in range(40)], k=rng.randint(1, 40))) for _ in range(4))) for i in range(60)]
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string"), templates, {}, 0.7).collect()}
    for i, text in docs:
        every = text.split()
        for label, t in templates:
            span = 2 * len(t.split())
            blocks = [line.split() for line in text.split("\n")] + [every[k : k + span] for k in range(len(every))]  # a run inside a line is a part of it
            assert (label in got[i]) == any(len(set(t.split()) & set(b)) >= 0.7 * len(set(t.split())) - 1e-9 for b in blocks)


def test_languages(spark, hard, empty):
    words = {"en": "the and with this that".split(), "de": "der und mit nicht auch".split(), "fr": "le est avec dans pour".split()}
    rows = [(k, " ".join(words[g][(k * 7 + i * i) % 5] for i in range(12)), g, "s") for g in words for k in range({"en": 0, "de": 200, "fr": 400}[g], {"en": 200, "de": 400, "fr": 600}[g])]
    df = spark.createDataFrame(rows + [(9000, None, "en", "s"), (9001, "12 34 !!", "en", "s"), (9002, "²½", None, "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in L.identify_languages(df).collect()}
    held = [(got[k].lang_pred, g) for k, _, g, _ in rows if got[k].held_out]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(got[k].lang_pred == L.UNKNOWN and got[k].score == 0 for k in (9000, 9001, 9002))
    assert L.identify_languages(hard).count() == hard.count() and L.identify_languages(empty).count() == 0


def test_mix(spark, hard, empty):
    rows = mix(hard).collect()
    assert len(rows) == hard.count()
    total = sum(r.size for r in rows)
    filled = [r for r in rows if r.size]  # a source's target, spread over its words
    assert sum(r.target * r.size / r.source_size for r in filled) == pytest.approx(1.5 * total) and all(r.target <= 2 * r.source_size for r in rows)
    for key in {(r.source_size, r.target) for r in filled}:
        mine = [r for r in filled if (r.source_size, r.target) == key]
        assert sum(r.taken for r in mine) == pytest.approx(sum(r.target * r.size / r.source_size for r in mine), abs=2)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    out = repeat_rows(hard)
    assert out.columns == hard.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in out.collect()) == sum(r.taken for r in rows)
    assert mix(empty).count() == 0 and repeat_rows(empty).count() == 0


def test_warc(spark):
    pages = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (5, "u", None), (4, "u", ""), (9, "u", "ü" * 50_000), (None, "u", "<p>x</p>"), (7, "u", "\x1f\x8b\x08 WARC/1.1")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = new_path(spark, "warc")
    write_warc(df.repartition(2), path)
    for size in (97, 1 << 20):
        got = {r.page_id: r for r in read_warc(spark, path, size).collect()}
        assert len(got) == len(pages)
        assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 5: ("response", None), 4: ("revisit", 5), 9: ("response", None), None: ("revisit", 2), 7: ("response", None)}
        assert got[9].payload_bytes == 100_000 and got[9].payload.decode() == "ü" * 50_000 and got[1].payload_bytes == 8 and got[1].payload is None
    none = new_path(spark, "warc")
    write_warc(df.limit(0), none)
    assert read_warc(spark, none).count() == 0


def test_foreign_archives(spark, tmp_path):
    """Records of other tools: other types, header names in any case, no digest or another label, and a member that is cut off."""
    import gzip
    import hashlib
    import base64

    def record(kind, block, *more):
        return gzip.compress("\r\n".join(["WARC/1.0", f"content-length: {len(block)}", f"WARC-TYPE: {kind}", *more, "", ""]).encode() + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n<p>x</p>"
    sha = base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode()
    parts = [record("warcinfo", b"software: x"), record("request", b"GET / HTTP/1.1\r\n\r\n"), record("response", http, "warc-record-id: <urn:lumenloom:page:7>", f"WARC-Payload-Digest: SHA1:{sha.lower()}"), record("response", http), record("metadata", b""), record("response", http * 900)[:-40]]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"")
    for size in (64, 1 << 20):
        got = read_warc(spark, f"file://{tmp_path}", size).collect()
        assert sorted(r.record_type for r in got) == ["metadata", "request", "response", "response", "truncated", "warcinfo"]
        whole = [r for r in got if r.record_type == "response"]
        assert {(r.payload_bytes, r.payload_digest) for r in whole} == {(8, sha)} and sorted(r.page_id or 0 for r in whole) == [0, 7]


def test_random_pages_against_a_plain_model(spark):
    """Repeated rows, null ids, columns with the operator's own names: types, references, sizes and digests as a plain model gives them."""
    import base64
    import hashlib
    import random

    rng = random.Random(5)
    pages = [(rng.choice([None, *range(40)]), "http://h/x", rng.choice([None, "", "a", "<p>ü</p>", "x" * 3000, f"own {k}"])) for k in range(120)]
    df = spark.createDataFrame([(*p, 1, "clash") for p in pages], "page_id long, url string, html string, sha int, best string")
    path = new_path(spark, "warc")
    write_warc(df.repartition(3), path, least_bytes=1)
    best = {}
    for ident, _, html in pages:
        best.setdefault(html or "", []).append(ident)
    want = []
    for ident, _, html in pages:
        own = (html or "").encode()
        ids = [k for k in best[html or ""] if k is not None]
        first = max(ids) if ids else None
        revisit = len(best[html or ""]) > 1 and len(own) >= 1 and first is not None and ident != first
        want.append((ident, "revisit" if revisit else "response", first if revisit else None, len(own), base64.b32encode(hashlib.sha1(own).digest()).decode()))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for size in (300, 1 << 20):
        got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in read_warc(spark, path, size).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_damaged_archives(spark, tmp_path):
    """Members that don't inflate, payloads without their digest, ids of other writers."""
    from lumenloom.llm.warc import member

    parts = [bytearray(member(k, "u", bytes(f"page {k} " * 200, "ascii"), None, False, "2000-01-01T00:00:00Z")) for k in range(6)]
    for at in (60, 61):
        parts[1][len(parts[1]) // 2 + at - 60] ^= 0xFF
    good = member(3, "u", b"one", None, False, "2000-01-01T00:00:00Z")
    import gzip

    text = gzip.decompress(good)
    parts[3] = bytearray(gzip.compress(text.replace(b"\r\n\r\none", b"\r\n\r\ntwo")))
    parts[4] = bytearray(gzip.compress(text.replace(b"<urn:lumenloom:page:3>", b"<urn:uuid:4d5d6b6a-0000-4000-8000-abcdef012345>")))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(bytes, parts)))
    for size in (50, 1 << 20):
        got = read_warc(spark, f"file://{tmp_path}", size).collect()
        assert sorted((r.record_type, r.page_id is None, r.page_id or 0) for r in got) == [("corrupt", False, 3), ("corrupt", True, 0), ("response", False, 0), ("response", False, 2), ("response", False, 5), ("response", True, 0)]
        assert [bytes(r.payload) for r in got if r.record_type == "response" and r.page_id is None] == [b"one"]


def test_license_base_columns(spark):
    """Against a plain scan of random texts, and with empty lists of templates and phrases."""
    import random

    rng = random.Random(8)
    phrases = {"cc by": ("cc", "by"), "general public license": ("general", "public", "license"), "all rights reserved": ("all", "rights", "reserved")}
    label = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    parts = ["CC", "by", "cc-BY", "general", "public", "License", "all", "rights", "reserved", "x", "ü9", "cc by", "all rights reserved"]
    docs = [(i, "".join(rng.choice(parts) + rng.choice([" ", "\n", ", ", "-", "_"]) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(df).collect()}
    for i, text in docs:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(k, p) for p, w in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(w)]) == w]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label[p] for _, p in places}))
    assert {(r.n_base, r.labels, r.score) for r in license_scan(df, [], {}).collect()} == {(0, "", 0.0)}


def test_language_scores_recomputed(spark):
    """A prediction's score from the model's tables by plain loops."""
    import math
    from collections import Counter

    texts = ["the cat and the dog with this", "der hund und die katze nicht", "le chien et le chat avec"] * 40
    model = L.fit(texts, ["en", "de", "fr"] * 40)
    for text in ("the dog and the cat", "und nicht", "x" * 3000, "Le Chat, 12!"):
        code = " " + " ".join(re.sub(r"[^a-z]+", " ", text.lower()).split()) + " "
        seen = Counter()
        for n in L.ORDERS:
            for i in range(len(code) - n + 1):
                h = 0
                for ch in code[i : i + n]:
                    h = ((h ^ ord(ch)) * 0x9E3779B1) & 0xFFFFFFFF
                    h ^= h >> 15
                seen[((h * 0x85EBCA6B) & 0xFFFFFFFF) >> 17] += 1
        total = sum(seen.values())
        logits = [(sum(c * model.logits[b][k] for b, c in seen.items()) / total + model.bias[k]) / model.temperature for k in range(3)]
        top = max(logits)
        p = [math.exp(x - top) for x in logits]
        lang, score, _ = model.predict(text)
        assert model.languages[p.index(max(p))] == lang and score == pytest.approx(max(p) / sum(p), abs=1e-6)
