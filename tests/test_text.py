import pytest
from pyspark.sql import functions as F

from lumenloom.functions import instants as I
from lumenloom.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


CASES = [
    (lambda: X.fold_channel_id(F.lit("TRT.ÇOCUK.tr")), "TRTCOCUK.tr"),
    (lambda: X.fold_channel_id(X.fold_channel_id(F.lit("şık.kanal.tr"))), "SIKKANAL.tr"),
    (lambda: X.fold_channel_id(F.lit("[SVT1HD].SVT1.HD.se")), "[SVT1HD].SVT1.HD.se"),
    (lambda: X.fold_channel_id(F.lit("http://a.b/x.tr")), "http://a.b/x.tr"),
    (lambda: X.is_canonical_id(F.lit("KANALD.tr")), True),
    (lambda: X.is_canonical_id(F.lit("Kanal D.tr")), False),
    (lambda: X.channel_id_from_name(F.lit("DİYANET TV")), "DIYANET.TV.tr"),
    (lambda: X.channel_id_from_name(F.lit(" ")), "UNKNOWN.tr"),
    (lambda: X.normalize_name(F.lit("Kanal Çocuk – ﬁlm")), "KANAL COCUK FILM"),
    (lambda: X.strip_resolution(F.lit("ATV (360p)")), "ATV"),
    (lambda: X.strip_quality_tokens(F.lit("HD Film UHD")), "FILM"),
    (lambda: X.strip_quality_qualifier(F.lit("HD")), "HD"),
    (lambda: X.strip_quality_qualifier(F.lit("TRT 1 fhd ")), "TRT 1"),
    (lambda: X.id_key(F.lit("KANAL D HD.tr")), "KANAL D"),
    (lambda: X.id_key(F.lit(" EXT ")), ""),
    (lambda: X.canonical_group_title(F.lit(" haber-spor  İÇ ")), "Haber-spor Iç"),
    (lambda: X.canonical_group_title(F.lit("SPORTS")), "Sport"),
    (lambda: X.decode_entities(F.lit("&amp;lt; &#x131;&#305; &nbsp;|&#0;&#xD800;&foo;&#99999999999;")), "&lt; ıı  |&#0;&#xD800;&foo;&#99999999999;"),
    (lambda: X.escape_xml(F.lit('<a & "b">\x01')), "&lt;a &amp; &quot;b&quot;&gt;"),
    (lambda: X.escape_display_name(F.lit('a, "b"\r\nc')), "a 'b' c"),
    (lambda: X.normalize_stream_url(F.lit("HTTPS://User:pw@Host.TV:443/a/b.M3U8?x=1#f")), "http://host.tv/a/b"),
    (lambda: X.normalize_stream_url(F.lit("http://h:8080/x//?b=2&a=1&a"), keep_query=True), "http://h:8080/x?a=1&a=&b=2"),
    (lambda: X.normalize_stream_url(F.lit(" not a url ")), "not a url"),
    (lambda: X.redact_url(F.lit("http://u:p@h/x?Token=s3&b=1&app_id=9")), "http://h/x?Token=REDACTED&b=1&app_id=REDACTED"),
    (lambda: X.redact_url(F.lit("not a url?token=x")), "not a url?token=x"),
    (lambda: X.redact_url(F.lit("http://h/?%74oken=s&x=%zz")), "http://h/?token=REDACTED&x=%zz"),
    (lambda: X.trim(F.lit(" ﻿x　")), "x"),
    (lambda: X.to_portable_id(F.lit("Şık  Kanal é..x")), "sik.kanal.e.x"),
    (lambda: X.episode_label(F.lit(2), F.lit(3)), "Säsong 2, Avsnitt 3"),
    (lambda: X.matches_any(F.array(F.lit("ATV ALANYA")), ["atv"]), False),
    (lambda: X.matches_any(F.array(F.lit("ATV ALANYA")), ["* Alanya *"]), True),
    (lambda: X.matches_any(F.array(F.lit("A+B")), ["a+?"]), True),
    (lambda: I.guide_epoch(F.lit("2026-02-30T10:00:00+03:00")), None),
    (lambda: I.guide_epoch(F.lit("2026-09-08T15:00:00+23:59")), 1788793260),
    (lambda: I.from_xmltv(F.lit("20260908150000 +0300")), "2026-09-08T15:00:00+03:00"),
    (lambda: I.from_xmltv(F.lit("20260931150000 +0300")), None),
    (lambda: I.to_xmltv(F.lit("2026-09-08T15:00:00.5+03:00")), None),
    (lambda: I.wall_to_instant(F.lit("2026-12-31").cast("date"), F.lit(1440)), "2027-01-01T00:00:00+03:00"),
    (lambda: I.clock_minutes(F.lit(24), F.lit(0)), None),
    (lambda: I.clock_minutes(F.lit(24), F.lit(0), True), 1440),
    (lambda: F.right(I.epoch_to_iso(F.lit(1793000000000), "Europe/Stockholm"), F.lit(6)), "+01:00"),
    (lambda: I.turkish_date(F.lit("8 Eylül 2026 - Salı")).cast("string"), "2026-09-08"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(spark, k):
    make, want = CASES[k]
    assert value(spark, make()) == want
