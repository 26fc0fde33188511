"""What commands, settings and lists decide, case by case, beside the decisions that are expected."""

import json
import tempfile
from pathlib import Path

import pytest

from lumenloom import cli, settings
from lumenloom.operators import guide as G
from lumenloom.operators.guide import Guide
from lumenloom.sources import m3u

CASES = {}


def _first_complaint(flags: str) -> str:
    return next(cli.complaints(cli.parser().parse_args(flags.split())), "")


FLAGS = [
    ("--provider a", ""), ("--provider a --date 1", "--date: YYYY-MM-DD expected, not 1"), ("--provider a --date 2026-02-30", "--date: 2026-02-30 is no date"), ("--provider a --days-back 60", ""), ("--provider a --days-back 61", "--days-forward, --days-back: whole numbers from 0 to 60 expected"),
    ("--provider a --days-forward 1x", "--days-forward, --days-back: whole numbers from 0 to 60 expected"), ("--provider ,", "--provider: an id is missing"), ("--merge --compare", "--compare and --merge exclude each other"), ("--provider a,b,c --compare", "--compare: two providers at most"),
    ("--provider a,b", "several providers need --merge or --compare"), ("--from x", "--from needs --merge or --compare"), ("--from , --merge", "--from: a path is missing"), ("--provider a --sports-only", "--sports-only needs --merge"), ("--m3u x --merge", "--m3u excludes the flags of guides"),
    ("--provider a --max-channels 0", "--max-channels: a positive whole number expected"), ("--provider a,b --date x", "--date: YYYY-MM-DD expected, not x"), ("--m3u x --m3u-want a", ""), ("--provider a,b --merge --exclusive-channels", ""),
]
CASES["command_flags"] = (FLAGS, _first_complaint)
CASES["output_names"] = ([("a TR ", "epg_a_TR.xml"), ("merged SE z", "epg_merged_SE.xml.gz")], lambda g: cli._name(*g.split(" ")[:2], bool(g.split(" ")[2])))
CASES["command_window"] = ([("0 0", "2026-03-01"), ("1 1", "2026-02-28 2026-03-01 2026-03-02"), ("0 2", "2026-03-01 2026-03-02 2026-03-03")], lambda g: " ".join(map(str, cli.window(cli.parser().parse_args(["--date", "2026-03-01", "--days-back", g.split()[0], "--days-forward", g.split()[1]]), "UTC"))))


def _setting(text: str) -> str:
    with tempfile.TemporaryDirectory() as d:
        p = Path(d) / "s.json"
        p.write_text(text, encoding="utf-8")
        try:
            s = settings.load_playlist(p, env={"HOST": "h"}, catalog=[{"pattern": " trt* ", "group": "Ulusal"}, {"group": "lost"}], want=["last"])
        except settings.SettingsError as e:
            return str(e).replace(str(p), "FILE").split(" column")[0]
    return f"{s.sources[0]['path']} {','.join(s.options.want)} {s.options.style} {s.options.max_copies} {len(s.options.rules)}"


SETTINGS = [
    ('{"sources": [{"url": "${HOST}/a"}]}', "h/a trt*,last backup 6 1"), ('{"sources": [{"url": "${NO:-x}"}], "want": ["w"], "style": "none", "maxCopies": 0}', "x trt*,w,last none 0 1"), ('{"sources": [{"url": "a"}], "catalog": false}', "a last backup 6 0"),
    ('{"sources": [{"url": "${NO}"}]}', "sources[0].url: NO is not set"), ('{"sources": []}', "sources: a list of 1 to 50 expected"), ('{"sources": [{"url": "a", "x": 1}]}', "sources[0]: unknown x"), ('{"sources": [{"url": "a"}], "y": 1}', "settings: unknown y"),
    ('{"sources": [{"url": "a"}], "maxCopies": true}', "maxCopies: a whole number from 0 to 1000 expected"), ('{"sources": [{"url": "a"}], "live": {"depth": 3}}', "live.depth: a whole number from 1 to 2 expected"), ('{"sources": [{"url": "a"}], "want": [" "]}', "want: a list of texts expected that aren't blank"), ("[]", "settings FILE: a JSON object expected"),
]
CASES["playlist_settings"] = (SETTINGS, _setting)


def _flagged(flags: str) -> str:
    s = settings.PlaylistSettings([{"id": "a", "path": "a"}], settings.PlaylistOptions(want=["w"]))
    try:
        s = cli.overridden(s, cli.parser().parse_args(["--m3u", "x", *flags.split()]))
    except cli.Refused as e:
        return str(e)
    o = s.options
    return f"{','.join(x['path'] for x in s.sources)} {','.join(o.want)} {o.style} {o.max_copies} {int(o.unify_scheme)}{int(o.keep_query)}{int(o.infer_id)}{int(o.use_backups)} {','.join(f'{k}={v}' for k, v in s.live.items())}".strip()


PLAYLIST_FLAGS = [
    ("", "a w backup 6 1011"), ("--m3u-want x,y --m3u-style none", "a w,x,y none 6 1011"), ("--m3u-sources b,c --m3u-max-copies 0", "b,c w backup 0 1011"), ("--m3u-keep-scheme --m3u-keep-query --m3u-no-infer-tvg-id --m3u-no-yedek", "a w backup 6 0100"),
    ("--m3u-live-keep --m3u-live-depth 2", "a w backup 6 1011 depth=2,enabled=True,keepFailed=True"), ("--m3u-live --m3u-live-retry 0", "a w backup 6 1011 retries=0,enabled=True"), ("--m3u-max-copies 1001", "--m3u-max-copies: a whole number from 0 to 1000 expected"),
    ("--m3u-max-bytes 1023", "--m3u-max-bytes: a whole number from 1024 to 268435456 expected"), ("--m3u-live-concurrency 9", "--m3u-live-concurrency: a whole number from 1 to 8 expected"), ("--m3u-style odd", "--m3u-style: one of numbered, parenthesized, none, backup, source, keep-first, fail expected"),
]
CASES["playlist_flags"] = (PLAYLIST_FLAGS, _flagged)


def _env(text: str) -> str:
    with tempfile.TemporaryDirectory() as d:
        (p := Path(d) / ".env").write_text(text, encoding="utf-8")
        return "|".join(f"{k}={v}" for k, v in settings.read_env(p).items())


CASES["env_files"] = ([("# n\nexport A=1 # e\nB=\"two words\"\nC='x#y'", "A=1|B=two words|C=x#y"), ("D=\nA-B\n9=1", "D="), ("T=`a b`\nE=\"x\\ny\"", "T=a b|E=x\ny")], _env)
CASES["alias_files"] = ([('{"A.tr": "B.tr", "b.TR": "C.tr"}', "A.TR=C.tr,B.TR=C.tr"), ('{"x": 1}', ""), ('{"x": "Y", "Y": "x"}', "X=x,Y=Y")], lambda g: ",".join(f"{k}={v}" for k, v in sorted(G.resolve_aliases(json.loads(g)).items())))
CASES["value_lists"] = ([("a, b ,,c", "a|b|c"), (" ", ""), ("x", "x")], lambda g: "|".join(settings.split_list(g)))


@pytest.mark.parametrize("name", CASES)
def test_decisions(name):
    cases, decide = CASES[name]
    assert [(given, decide(given)) for given, _ in cases] == cases


BAD = [("sound", ""), ("blank name", "1 entries without a name"), ("placeholder", "1 entries with a placeholder as id"), ("no url", "1 entries without an http(s) URL"), ("twice", "1 repeated URLs; 1 repeated names; 1 repeated ids")]


@pytest.mark.parametrize(("name", "verdict"), BAD)
def test_playlist_validation(spark, name, verdict):
    base = [("A", "a.tr", "http://h/1"), ("B", "b.tr", "http://h/2")]
    more = {"sound": ("C", "", "https://h/3"), "blank name": (" ", "c.tr", "http://h/3"), "placeholder": ("C", "ext", "http://h/3"), "no url": ("C", "c.tr", "rtmp://h/3"), "twice": ("a", "A.tr", " http://h/1 ")}
    rows = spark.createDataFrame([*base, more[name]], "name string, tvg_id string, url string")
    if not verdict:
        m3u.validate(rows)
        return
    with pytest.raises(ValueError) as e:
        m3u.validate(rows)
    assert str(e.value) == verdict


def test_empty_guides(spark):
    channels = spark.createDataFrame([("a.tr", "A")], "id string, name string")
    slots = spark.createDataFrame([("a.tr", "x")], "channel string, title string")
    assert cli.is_empty(Guide(channels.limit(0), slots.limit(0))) and cli.is_empty(Guide(channels, slots.limit(0)))
    assert not cli.is_empty(Guide(channels, slots))
