import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenloom.scratch import new_path
from lumenloom.sources import records as R
from lumenloom.sources import m3u, xmltv


def folder(spark):
    path = Path(new_path(spark, "files").removeprefix("file://"))
    path.mkdir(parents=True)
    return path


@pytest.fixture
def split_size(spark):
    """Sets the bytes of a split; the session's own are back at the end."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {k: spark.conf.get(k) for k in keys}

    def set_to(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")

    yield set_to
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [64, 1000, 1 << 27])
def test_records_are_the_same_in_any_split(spark, split_size, size):
    rng = random.Random(size)
    pieces = ["".join(rng.choice("ab\nü</") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    path = folder(spark) / "x.txt"
    path.write_text("</end".join(pieces) + "x", encoding="utf-8")
    split_size(size)
    rows = R.read(spark, [str(path)], "</end")
    if size == 64:
        assert rows.rdd.getNumPartitions() > 20
    got = R.placed(rows.cache(), ["provider"]).orderBy("seq").collect()
    assert [r.value for r in got] == [*pieces[:-1], pieces[-1] + "x"]
    assert [r.tail for r in got] == [False] * 199 + [True] and got[0].seq == 0


def guide_text():
    day = "202609{:02}{:02}0000 +0300"
    channels = "".join(f'<channel id="C{k}.tr"><display-name>{"" if k == 3 else f"C &amp; {k}"}</display-name></channel>\n' for k in range(40))
    slots = "".join(f'<programme start="{day.format(1 + n % 20, n % 23)}" stop="{day.format(1 + n % 20, n % 23 + 1)}" channel="C{n % 45}.tr"><title lang="{"sv" if n > 9 else "?"}">T&lt;{n}</title>{"<programme>" if n % 31 == 0 else ""}<desc>ü{n}</desc></programme>\n' for n in range(500))
    late = '<channel id="C41.tr"><display-name lang="de">late</display-name></channel><channel id="C1.tr"><display-name>again</display-name></channel>'
    return '<?xml version="1.0"?>\n<tv>' + channels + slots + late + '<programme start="20260901000000 +0300" stop="20260901010000 +0300" channel="C2.tr"><title>no end</title>'


def seen(guide):
    ch = [tuple(r) for r in guide.channels.orderBy("provider", "seq").select("provider", "id", "name").collect()]
    return ch, [tuple(r) for r in guide.programmes.orderBy("provider", "seq").select("provider", "channel", "start", "stop", "title", "desc").collect()], guide.language, guide.languages


def test_a_guide_reads_alike_in_any_split(spark, split_size):
    where, text = folder(spark), guide_text()
    (where / "a.xml").write_text(text, encoding="utf-8")
    with gzip.open(where / "a.xml.gz", "wt", encoding="utf-8") as f:
        f.write(text)
    whole = seen(xmltv.parse(spark.createDataFrame([(0, text)], "provider int, value string")))
    # programmes 0, 31, .. hold an opening of their own: the section that has the end has no channel
    assert len(whole[0]) == 41 and whole[0][1] == (0, "C1.tr", "C & 1") and whole[0][-1] == (0, "C41.tr", "late")
    assert whole[2] == "de" and not any(t == "no end" for *_, t, _ in whole[1]) and len(whole[1]) > 400
    for size, name in [(4096, "a.xml"), (1 << 27, "a.xml"), (4096, "a.xml.gz")]:
        split_size(size)
        assert seen(xmltv.read(spark, [str(where / name)])) == whole
    split_size(4096)
    both = seen(xmltv.read(spark, [str(where / "a.xml"), str(where / "a.xml.gz")]))
    assert len(both[1]) == 2 * len(whole[1]) and both[3] == ("de", "de")


@pytest.mark.parametrize("packed", [True, False])
def test_one_file_of_many_tasks(spark, packed):
    rows = spark.range(5000).select("id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("value")).repartition(7, F.rand(1))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are one part
    try:
        paths = [new_path(spark, "joined"), new_path(spark, "parts")]
        sizes = [R.write(rows, ["id"], p, packed, whole=k == 0) for k, p in enumerate(paths)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    files = [sorted(x for x in Path(p.removeprefix("file://")).iterdir() if x.name.startswith("part-")) for p in paths]
    assert len(files[0]) == 1 and len(files[1]) > 1
    body = files[0][0].read_bytes()
    parts = b"".join(p.read_bytes() for p in files[1])
    text = gzip.decompress(body) if packed else body
    assert text == (gzip.decompress(parts) if packed else parts) and sizes[0] >= len(body)
    assert text.decode().splitlines() == [f"line {k}" for k in range(5000)]
    for p in paths:
        read = R.placed(R.read(spark, [p], "\n").cache(), ["provider"]).orderBy("seq")
        assert [r.value for r in read.collect()] == text.decode().splitlines()


def playlist_text():
    rng = random.Random(5)
    lines = ["﻿#EXTM3U"]
    for k in range(400):
        lines += [f'#EXTINF:-1 tvg-id="i{k}" group-title="G",Ü {k}', *["#EXTGRP: Own"][: k % 7 == 0], *["#EXTVLCOPT:a=b", "#EXTVLCOPT:c=d"][: k % 3], "", *[f"http://h/{k}"] * rng.choice([0, 1, 1, 1, 2])]
    return "\r\n".join(lines)


def listed(found):
    entries, stats = found
    return sorted(tuple(r) for r in entries.select("line", "name", "tvg_id", "group_title", "url", "vlc_options", "entry_id").collect()), [tuple(r) for r in stats.collect()]


def test_a_playlist_reads_alike_in_any_split(spark, split_size):
    where, text = folder(spark), playlist_text()
    path = where / "a.m3u"
    path.write_bytes(text.encode())
    files = spark.createDataFrame([("a", 0, 0.0, text)], "source_id string, source_order int, weight double, value string")
    for most_bytes, most in [(0, 10**9), (7001, 10**9), (10**6, 50)]:
        whole = listed(m3u.parse(files, most_bytes, most))
        urls = [r[4] for r in whole[0]]
        assert urls == sorted(urls, key=lambda u: int(u.rsplit("/", 1)[1])) and len(set(urls)) == len(urls)
        assert whole[1][0][-1] == (most_bytes == 7001 or most == 50) and (most != 50 or len(urls) == 50)
        for size in (512, 1 << 27):
            split_size(size)
            assert listed(m3u.read(spark, [{"id": "a", "path": str(path)}], most_bytes, most)) == whole
    plain = text.encode().removeprefix(b"\xef\xbb\xbf")[:7001].decode(errors="replace")
    kept = [x for x in plain.split("\n") if x.startswith("#EXTINF")]
    entries, stats = m3u.parse(files, 7001)
    assert stats.first().parsed + stats.first().missing_url == len(kept)
    lines = text.removeprefix("﻿").split("\r\n")
    for r in m3u.parse(files, 0)[0].collect():
        assert lines[r.line - 1].endswith("," + r.name)
