import datetime as dt
import json

from lumenloom.operators.guide import normalise
from lumenloom.providers import GuideSource
from lumenloom.sources import pages
from lumenloom.sources.saved import SavedPages

DAYS = [dt.date(2026, 9, 8), dt.date(2026, 9, 9)]


def flat(served, *slots):
    rows = "".join(f'<li  ><div class="time">{t}</div><div class="program-name">{n} </div></li>\n' for t, n in slots)
    return f'<title>Kanal {served} tarihli Yayın Akışı</title>\n<ul class="epg-list">\n{rows}</ul>'


def test_start_only_pages(spark, tmp_path):
    (tmp_path / "TRT 1_2026-09-08.html").write_text(flat("8 Eylül 2026", ("20:00", "News"), ("21:30", "Film")))
    (tmp_path / "TRT 1_2026-09-09.html").write_text(flat("8 Eylül 2026", ("20:00", "Stale")))
    (tmp_path / "A+B_2026-09-09.html").write_text(flat("", ("10:00", "Unsaid")))
    (tmp_path / "A+B_2026-09-10.html").write_text(flat("10 Eylül 2026", ("10:00", "Outside")))
    source = SavedPages(pages.flat_list, {"trt 1": "TRT1.tr"})
    assert isinstance(source, GuideSource)
    guide = normalise(source.read(spark, [str(tmp_path)], DAYS))[0]
    rows = {tuple(r) for r in guide.programmes.select("channel", "start", "stop", "title").collect()}
    assert rows == {("TRT1.tr", "2026-09-08T20:00:00+03:00", "2026-09-08T21:30:00+03:00", "News"), ("TRT1.tr", "2026-09-08T21:30:00+03:00", "2026-09-09T00:00:00+03:00", "Film")}
    assert {r.id for r in guide.channels.collect()} == {"TRT1.tr", "AB.tr"}  # folded ids carry no dots
    lenient = SavedPages(pages.flat_list, unsaid=True).read(spark, [str(tmp_path)], DAYS)
    assert {r.title for r in lenient.programmes.collect()} == {"News", "Film", "Unsaid"}


def test_pages_with_ends_and_look_back(spark, tmp_path):
    def answer(*slots):
        return json.dumps({"playbilllist": [{"starttime": f"{a} UTC+03:00", "endtime": f"{b} UTC+03:00", "name": n, "genres": "x"} for a, b, n in slots]})

    (tmp_path / "A_2026-09-07.json").write_text(answer(("2026-09-07 22:00", "2026-09-07 23:00", "Before"), ("2026-09-08 00:10", "2026-09-08 01:00", "Late")))
    (tmp_path / "A_2026-09-08.json").write_text(answer(("2026-09-08 00:10", "2026-09-08 01:00", "Late"), ("2026-09-08 03:00", "2026-09-08 02:00", "Reversed")))
    source = SavedPages(pages.playbill, look_back=1)
    guide, _ = normalise(source.read(spark, [str(tmp_path)], DAYS[:1]))
    assert [(r.channel, r.title, r.category) for r in guide.programmes.collect()] == [("A.tr", "Late", "x")]
    assert source.read(spark, [str(tmp_path)], []).programmes.isEmpty()
