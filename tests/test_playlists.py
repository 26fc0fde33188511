import pytest
from pyspark.sql import functions as F

from lumenloom.operators import playlist as P
from lumenloom.operators.playlist import PlaylistOptions, Rule
from lumenloom.scratch import new_path
from lumenloom.sources import m3u

TEXT = """﻿#EXTM3U x-tvg-url="http://e" | trailing
#EXTINF:-1 tvg-id="TV8,5 HD.tr" tvg-name="TV8,5" tvg-logo="http://l" group-title="ULUSAL" Yedek2="http://b2" yedek="http://b1" Yedek3="http://u1",TV8,5
#EXTVLCOPT:http-user-agent=x
http://u1
http://extra
#EXTINF:-1 tvg-id=ext tvg-name="open,ATV (360p)
#EXTGRP: Haber
https://U2:443/a.m3u8
#EXTINF:-1,No url
#EXTINF:-1 tvg-id="ext" TVG-ID="ext" tvg-name="",ATV HD

#OTHER
http://u3
"""


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame([("s", 0, 1.0, TEXT)], "source_id string, source_order int, weight double, value string")
    return m3u.parse(files)


def test_parse(parsed):
    entries, stats = parsed
    got = entries.orderBy("entry_id").collect()
    assert [(r.name, r.tvg_id, r.group_title, r.url, r.line) for r in got] == [("5", "TV8,5 HD.tr", "ULUSAL", "http://u1", 2), ("ATV (360p)", "", "Haber", "https://U2:443/a.m3u8", 6), ("ATV HD", "ext", "", "http://u3", 10)]
    assert got[0].vlc_options == ["http-user-agent=x"] and got[0].attributes["yedek2"] == "http://b2"
    s = stats.first()
    assert (s.parsed, s.missing_url, s.extra_urls, s.malformed) == (3, 1, 1, 1)


def test_a_long_junk_line_is_linear(spark):
    files = spark.createDataFrame([("s", 0, 1.0, "#EXTINF:-1 " + "a" * 100_000 + ",x\nhttp://u")], "source_id string, source_order int, weight double, value string")
    assert m3u.parse(files)[0].first().name == "x"


def test_backups(parsed):
    got = P.expand_backups(parsed[0]).orderBy("entry_id", "copy_no").collect()
    assert [(r.copy_no, r.url) for r in got[:3]] == [(0, "http://u1"), (1, "http://b1"), (2, "http://b2")] and len(got) == 5
    assert got[1].attributes == {} and got[1].vlc_options == []


def test_flow(parsed):
    out = P.build(parsed[0], PlaylistOptions(style="none", rules=[Rule("ATV", id="atv.tr", group="Ulusal")]))
    got = {r.url: r for r in out.entries.collect()}
    assert len(got) == 5 and got["http://u3"].tvg_id == got["https://U2:443/a.m3u8"].tvg_id == "atv.tr"
    assert got["http://u1"].name == got["http://b1"].name
    stats = out.stats.first()
    assert (stats.parsed, stats.backups_found, stats.groups, stats.written) == (3, 2, 2, 5)


def test_write_and_read_back(spark, parsed):
    out = P.build(parsed[0], PlaylistOptions(style="backup")).entries
    path = new_path(spark, "m3u")
    m3u.write(out, path)
    back = m3u.read(spark, [{"id": "x", "path": path}])[0]
    assert sorted(r.url for r in back.collect()) == sorted(r.url for r in out.collect())
    with pytest.raises(ValueError, match="repeated"):
        m3u.validate(out.unionAll(out))


def entry(n, name, tvg_id="", group="", url=None, weight=0.0):
    return (n, "s", 0, weight, n, name, tvg_id, "", "", group, {}, [], url or f"http://h/{n}")


SCHEMA = "entry_id long, source_id string, source_order int, weight double, line int, name string, tvg_id string, tvg_name string, tvg_logo string, group_title string, attributes map<string,string>, vlc_options array<string>, url string"


def test_components_are_transitive_and_editions_stay_apart(spark):
    e = spark.createDataFrame([entry(1, "ATV HD"), entry(2, "x", "ATV.tr"), entry(3, "X (720p)"), entry(4, "ATV Alanya"), entry(5, "!!"), entry(6, "??")], SCHEMA)
    keys = {r.entry_id: r.channel_key for r in P.group_channels(P.expand_backups(e)).collect()}
    assert keys[1] == keys[2] == keys[3] != keys[4] and keys[5] != keys[6]


def test_votes(spark):
    e = spark.createDataFrame([entry(1, "A", group="Undefined"), entry(2, "A", group="HABER"), entry(3, "A", group="spor", weight=2.0), entry(4, "A", group="")], SCHEMA)
    grouped = P.group_channels(P.expand_backups(e))
    assert {r.group_title for r in P.vote_labels(grouped).collect()} == {"Sport"}


def test_names_that_meet_are_numbered(spark):
    e = spark.createDataFrame([entry(1, "A"), entry(2, "A"), entry(3, "A Backup"), entry(4, "A Backup 2")], SCHEMA)
    named, _ = P.name_copies(P.group_channels(P.expand_backups(e)), "backup")
    names = [r.name.lower() for r in named.collect()]
    assert len(set(names)) == 4
    with pytest.raises(ValueError):
        P.name_copies(named, "unheard of")


def test_selection(spark):
    e = spark.createDataFrame([entry(1, "ATV"), entry(2, "ATV Avrupa"), entry(3, "Kanal D", group="Haber")], SCHEMA)
    kept, unmatched = P.select(e, ["ATV", "haber", "none"], [])
    assert sorted(r.entry_id for r in kept.collect()) == [1, 3] and [r.pattern for r in unmatched.collect()] == ["none"]
    kept, unmatched = P.select(e, ["ATV*"], ["* Avrupa"])
    assert [r.entry_id for r in kept.collect()] == [1]
