import datetime as dt
import gzip
import json
from pathlib import Path

import pytest

from lumenloom import cli, settings
from lumenloom.operators import guide as G
from lumenloom.operators import lookup as L
from lumenloom.operators.guide import Guide
from lumenloom.operators.playlist import Rule
from lumenloom.providers import Catalog, Context, Profile, Provider, context, notes, provider_of_file
from lumenloom.sources import xmltv

XML = """<?xml version="1.0" encoding="UTF-8"?><tv>
{channels}
{programmes}
</tv>"""


def guide_xml(slots):
    ids = dict.fromkeys(s[0] for s in slots)
    channels = "\n".join(f'<channel id="{i}"><display-name lang="tr">{i} name</display-name></channel>' for i in ids)
    rows = "\n".join(f'<programme start="{a} +0300" stop="{b} +0300" channel="{i}"><title lang="tr">{t}</title></programme>' for i, a, b, t in slots)
    return XML.format(channels=channels, programmes=rows)


@pytest.fixture
def guides(tmp_path):
    a, b = tmp_path / "epg_a_TR.xml", tmp_path / "epg_b_TR.xml.gz"
    a.write_text(guide_xml([("TRT1.tr", "20260908200000", "20260908210000", "News"), ("ATV.tr", "20260908200000", "20260908203000", "Film")]))
    b.write_bytes(gzip.compress(guide_xml([("TRT1.tr", "20260908210000", "20260908220000", "Late"), ("SPOR.tr", "20260908200000", "20260908203000", "Match")]).encode()))
    return [str(a), str(b)]


def settings_file(tmp_path, **kw):
    p = tmp_path / "settings.json"
    p.write_text("﻿" + json.dumps({"sources": [{"url": "a.m3u"}], **kw}))
    return p


def test_settings_defaults_and_expansion(tmp_path):
    s = settings.load_playlist(settings_file(tmp_path, sources=[{"url": "${HOST}/a.m3u", "weight": 2}, {"id": "b", "url": "${NONE:-x}/b"}]), env={"HOST": "h"})
    assert [(x["id"], x["path"], x["weight"]) for x in s.sources] == [("source-1", "h/a.m3u", 2.0), ("b", "x/b", 0.0)]
    assert (s.options.style, s.options.max_copies, s.options.quality_tokens, s.max_bytes) == ("backup", 6, ("HD", "FHD", "UHD", "SD"), 16 * 1024 * 1024)
    assert s.live == {"enabled": False, "keepFailed": False, "depth": 1, "timeoutMs": 6000, "concurrency": 4, "retries": 1}


@pytest.mark.parametrize(
    "bad",
    [
        {"sources": []}, {"sources": [{"url": " "}]}, {"sources": [{"url": "a", "x": 1}]}, {"sources": [{"url": "${NOT_SET_HERE}"}]}, {"sources": [{"url": "a"}] * 51}, {"unknown": 1}, {"style": "x"},
        {"want": ["a"] * 201}, {"want": [" "]}, {"maxCopies": -1}, {"maxCopies": True}, {"maxBytes": 10}, {"live": {"depth": 3}}, {"live": {"x": 1}}, {"output": []}, {"useYedek": "yes"}, {"idSuffix": ""},
    ],
)
def test_settings_refused(tmp_path, bad):
    with pytest.raises(settings.SettingsError):
        settings.load_playlist(settings_file(tmp_path, **bad), env={})


def test_settings_catalog(tmp_path):
    catalog = [{"pattern": " trt* ", "group": "Ulusal"}, {"pattern": "x", "id": "x.tr", "name": " "}, {"group": "lost"}, {"pattern": "plain"}]
    s = settings.load_playlist(settings_file(tmp_path, want=["more"]), env={}, catalog=catalog, want=["last"])
    assert s.options.want == ["trt*", "x", "plain", "more", "last"]
    assert s.options.rules == [Rule("trt*", group="Ulusal"), Rule("x", id="x.tr")]
    off = settings.load_playlist(settings_file(tmp_path, catalog=False), env={}, catalog=catalog)
    assert off.options.want == [] and off.options.rules == []


def test_env(tmp_path):
    p = tmp_path / ".env"
    p.write_text("# note\nexport A=1 # end\nB=\"two words\"\nC='x#y'\n\nD=\nA-B\n")
    assert settings.read_env(p) == {"A": "1", "B": "two words", "C": "x#y", "D": ""}
    assert settings.read_env(tmp_path / "none") is None
    target = {"A": "kept"}
    assert settings.apply_env({"A": "1", "B": "2"}, target) == ["B"] and target == {"A": "kept", "B": "2"}


def test_aliases_file(tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{"A.tr": "B.tr", "b.TR": "C.tr"}')
    assert G.resolve_aliases(settings.load_aliases(p))["A.TR"] == "C.tr"
    p.write_text("[]")
    with pytest.raises(settings.SettingsError):
        settings.load_aliases(p)


@pytest.mark.parametrize(
    ("flags", "part"),
    [
        ("--provider a --date 1", "YYYY-MM-DD"), ("--provider a --date 2026-02-30", "no date"), ("--provider a --days-back 61", "from 0 to 60"), ("--provider ,", "id is missing"),
        ("--provider a --merge --compare", "exclude each other"), ("--provider a,b,c --compare", "two providers"), ("--provider a,b", "need --merge"), ("--from x", "--from needs"),
        ("--from , --merge", "path is missing"), ("--provider a --sports-only", "--sports-only needs"), ("--m3u x --merge", "--m3u excludes"), ("--provider a --max-channels 0", "positive"),
        ("--provider a,b --days-forward x", "from 0 to 60"),
    ],
)
def test_first_complaint(flags, part, capsys):
    assert cli.main(flags.split()) == 1
    assert part in capsys.readouterr().err


def test_window():
    a = cli.parser().parse_args(["--date", "2026-03-01", "--days-back", "1", "--days-forward", "1"])
    assert cli.window(a, "Europe/Istanbul") == [dt.date(2026, 2, 28), dt.date(2026, 3, 1), dt.date(2026, 3, 2)]


def test_merge_command(spark, guides, tmp_path):
    out = str(tmp_path / "merged")
    catalog = Catalog([Provider("b", sports_ids=("SPOR.tr",))])
    assert cli.main(["--merge", "--from", ",".join(guides), "--sports-only", "--output", out], spark, catalog, lambda _: None) == 0
    rows = {(r.channel, r.title) for r in xmltv.read(spark, [out]).programmes.collect()}
    assert rows == {("TRT1.tr", "News"), ("ATV.tr", "Film"), ("SPOR.tr", "Match")}


def test_compare_command(spark, guides):
    lines = []
    assert cli.main(["--compare", "--from", ",".join(guides)], spark, log=lines.append) == 0
    assert lines[0].endswith("a vs b") and "common 1" in lines[1]


def test_single_command_and_empty_guide(spark, tmp_path, guides, capsys):
    class Saved:
        def read(self, spark, paths, dates):
            assert dates == [dt.date(2026, 9, 8)]
            found = xmltv.read(spark, paths)
            return found if "a_TR" in paths[0] else Guide(found.channels, found.programmes.limit(0))

    catalog, out = Catalog([Provider("a", source=Saved())]), str(tmp_path / "one")
    args = ["--provider", "a", "--date", "2026-09-08", "--output", out, "--pages"]
    assert cli.main([*args, guides[0]], spark, catalog) == 0
    assert xmltv.read(spark, [out]).channels.count() == 2
    assert cli.main([*args, guides[1]], spark, catalog) == 1
    assert "no empty guide" in capsys.readouterr().err
    assert cli.main(["--provider", "z", "--pages", "x"], spark, catalog) == 1


def test_playlist_command(spark, tmp_path):
    (tmp_path / "a.m3u").write_text('#EXTM3U\n#EXTINF:-1 tvg-id="TRT1.tr" yedek="http://h/2.m3u8",TRT 1\nhttp://h/1.m3u8\n#EXTINF:-1,Other\nhttp://h/3.m3u8\n')
    path = settings_file(tmp_path, sources=[{"id": "a", "url": str(tmp_path / "a.m3u")}], want=["trt*", "none*"], output={"path": str(tmp_path / "out")})
    lines = []
    assert cli.main(["--m3u", str(path), "--m3u-report", str(tmp_path / "r.json")], spark, log=lines.append) == 0
    text = "\n".join(f.read_text() for f in Path(tmp_path / "out").glob("part-*"))
    assert "TRT 1 Backup" in text and "Other" not in text and "no entry for none*" in lines
    assert json.loads((tmp_path / "r.json").read_text())["stats"]["written"] == 2
    assert cli.main(["--m3u", str(path), "--m3u-style", "fail"], spark, log=lines.append) == 1


def test_catalog(spark):
    c = Catalog([Provider("a", channel_ids=("x", "y", "x"), live_sports=True, scheduled=True, schedule_order=2), Provider("b", country="se", language="sv", zone="Europe/Stockholm", sports_ids=("z",), live_sports=True), Provider("c", scheduled=True, schedule_order=1, arguments=("--delay", "3"))])
    assert c.schedule() == [{"provider": "c", "args": "--delay 3"}, {"provider": "a", "args": ""}]
    assert [p.id for p in c.sports()] == ["a", "b"] and [p.id for p in c.sports(scheduled=True)] == ["a"]
    assert c.sports_ids("a") == ["x", "y"] and c.sports_ids("b") == ["z"] and c.sports_ids("?") is None
    assert context(c["b"]) == Context("SE", "sv", "Europe/Stockholm") and context(Provider("x", country="1", zone="Nowhere/X", language="?")) == Context("TR", "tr", "Europe/Istanbul")
    assert c.guide_files(Profile(("b", "a"), "o")) == ["epg_b_SE.xml.gz", "epg_a_TR.xml.gz"]
    assert {(r.id, r.channels) for r in c.inventory(spark).collect()} == {("a", 2), ("b", 0), ("c", 0)}
    for bad in (Provider("a"), Provider(" ")):
        with pytest.raises(ValueError):
            c.add(bad)
    with pytest.raises(TypeError):
        c.add(Provider("d", source=object()))
    assert [provider_of_file(f) for f in ("/x/epg_a_b_TR.xml.gz", "epg_a_TR.xml", "a.xml")] == ["a_b", "a", None]


def test_notes(spark):
    c = Catalog([Provider("a"), Provider("b")])
    rows = [("epg_a_TR.xml.gz", "X.tr", "Ch`x"), ("epg_a_TR.xml.gz", "A.tr", ""), ("epg_all_merged_TR.xml.gz", "X.tr", "X")]
    text = notes(spark.createDataFrame(rows, "file string, id string, name string"), c, {"all": Profile(("a", "b"), "epg_all_merged_TR.xml.gz", exclusive=True)}, "2026-09-08")
    assert "provider `a`, 2 channels" in text and "- A.tr (`A.tr`)\n- Ch'x (`X.tr`)" in text
    assert "merged guide `all`, 1 channels" in text and "`epg_a_TR.xml.gz` + `epg_b_TR.xml.gz`" in text and "first guide that lists" in text


def test_lookups(spark):
    ch = spark.createDataFrame([("TRT  Spor hd",), ("Şov TV",), (None,)], "name string")
    platform = spark.createDataFrame([("TRT SPOR 4K", "TRTSPOR.tr", "7", 1), ("trt spor", "late.tr", "8", 2)], "name string, id string, tv_id string, ord int")
    assert {r.name: (r.id, r.tv_id) for r in L.platform_ids(ch, platform).collect()} == {"TRT  Spor hd": ("TRTSPOR.tr", "7"), "Şov TV": (None, None), None: (None, None)}
    curated = spark.createDataFrame([("şov tv", "SHOW.tr", 2), ("ŞOV  TV", "FIRST.tr", 1)], "name string, id string, ord int")
    found = {r.name: r.id for r in L.curated_ids(ch, curated).collect()}
    assert found["Şov TV"] == "FIRST.tr" and found["TRT  Spor hd"] == "TRT.SPOR.HD.tr"
    empty = L.curated_ids(ch.limit(0), curated.limit(0))
    assert empty.isEmpty() and empty.columns == ["name", "id"]


def test_playlist_flags(tmp_path):
    s = settings.load_playlist(settings_file(tmp_path, live={"depth": 2, "retries": 3}, stripQuality=["HD"]), env={})
    changed = cli.overridden(s, cli.parser().parse_args(["--m3u", "x", "--m3u-live-retry", "1", "--m3u-strip-quality", "4K, UHD", "--m3u-max-bytes", "2048"]))
    assert (changed.live["retries"], changed.live["depth"], changed.options.quality_tokens, changed.max_bytes) == (1, 2, ("4K", "UHD"), 2048)
    assert (s.live["retries"], s.options.quality_tokens) == (3, ("HD",))
