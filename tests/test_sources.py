import random

from cuefind.sources import listing as LI
from cuefind.sources import subtitles as SU
from models import subtitles_model


def _fmt(ms):
    return f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def _random_file(rng):
    lines = ["WEBVTT", ""]
    timings = []
    for _ in range(rng.randint(0, 12)):
        if timings and rng.random() < 0.2:
            t = rng.choice(timings)
        else:
            a = rng.randint(0, 10_000_000)
            t = f"{_fmt(a)} --> {_fmt(a + rng.randint(0, 9000))}"
            timings.append(t)
        if rng.random() < 0.15:
            t += " align:start"
        lines.append(t)
        for _ in range(rng.randint(0, 3)):
            lines.append(rng.choice(["hello there", "<c>tag</c> kept", "x --> y", "zażółć"]))
        if rng.random() > 0.2:
            lines.append(rng.choice(["", "   ", "\t"]))
    return "\n".join(lines) + "\n"


def test_subtitles_random_against_model(spark):
    rng = random.Random(11)
    files = {f"v{i:02d}": _random_file(rng) for i in range(40)}
    df = spark.createDataFrame(list(files.items()), "video_id string, value string")
    for first_match in (True, False):
        got = SU.parse_subtitles(df, first_match=first_match).orderBy("video_id", "pos").collect()
        by_vid = {}
        for r in got:
            by_vid.setdefault(r.video_id, []).append((r.text, r.start_ms, r.end_ms))
        for vid, text in files.items():
            assert by_vid.get(vid, []) == subtitles_model(text, first_match), vid


def test_listing_parse(spark):
    df = spark.createDataFrame([("abc\tTitle one",), ("",), ("no tab",), (" def \t Two\tparts ",)], "value string")
    got = [tuple(r) for r in LI.parse_listing_lines(df).collect()]
    assert got == [("abc", "Title one", "https://www.youtube.com/watch?v=abc"),
                   ("def", "Two\tparts", "https://www.youtube.com/watch?v=def")]


def test_multi_playlist_first_wins(spark):
    from cuefind.session import scratch_path
    a, b = scratch_path(spark, "pl-a"), scratch_path(spark, "pl-b")
    spark.createDataFrame([("v2\tB two",), ("v3\tB three",)], "value string").coalesce(1).write.text(b)
    spark.createDataFrame([("v1\tA one",), ("v2\tA two",)], "value string").coalesce(1).write.text(a)
    got = {r.video_id: (r.title, r.playlist) for r in LI.first_listing_per_video(LI.read_listings(spark, [b, a])).collect()}
    assert got == {"v2": ("B two", 0), "v3": ("B three", 0), "v1": ("A one", 1)}


def _with_splits(spark, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return lambda: spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_large_subtitle_file_is_read_by_many_tasks(spark, tmp_path):
    """Line numbers, blank blocks and repeated cues across splits: the same segments as the file in one piece."""
    rng = random.Random(5)
    files = {"vbig": "\n".join(_random_file(rng) for _ in range(120)), "vsmall": _random_file(rng), "vdos": _random_file(rng).replace("\n", "\r\n"),
             "vempty": ""}
    for vid, text in files.items():
        folder = tmp_path / f"video_id={vid}"
        folder.mkdir()
        (folder / "subs.vtt").write_bytes(text.encode())
    back = _with_splits(spark, 600)
    try:
        scan = SU.read_subtitle_lines(spark, str(tmp_path))
        assert scan.rdd.getNumPartitions() > 20
        for first_match in (True, False):
            got = {}
            for r in SU.parse_subtitle_lines(scan, first_match=first_match).orderBy("video_id", "pos").collect():
                got.setdefault(r.video_id, []).append((r.text, r.start_ms, r.end_ms))
            assert got == {v: m for v, t in files.items() if (m := subtitles_model(t, first_match))}
    finally:
        back()
    assert {r.video_id for r in SU.subtitle_videos(spark, str(tmp_path)).collect()} == set(files) - {"vempty"}


def test_lines_are_numbered_across_splits_and_runs(spark, tmp_path):
    from pyspark.sql import functions as F

    from cuefind.sources import lines as LN
    texts = {"a.txt": "\n".join("" if i % 7 == 0 else f"line {i}" for i in range(900)), "b.txt": "one\r\ntwo\n\nthree", "c.txt": "\n\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    back = _with_splits(spark, 500)
    try:
        scan = LN.scan_lines(spark, str(tmp_path), "\n")
        got = LN.number_lines(scan, counts={"blank": F.col("value") == ""}, run_bits=3).collect()
    finally:
        back()
    for name, text in texts.items():
        lines = text.split("\n") if not text.endswith("\n") else text.split("\n")[:-1]
        want, blank = [], 0
        for i, line in enumerate(lines):
            blank += line == ""
            want.append((i, line, blank))
        assert sorted((r.line_no, r.value, r.blank) for r in got if r.source.endswith(name)) == want


def test_a_large_listing_keeps_the_order_of_its_lines(spark, tmp_path):
    lines = [f"v{i % 300:04d}\tTitle {i}" for i in range(1500)]
    (tmp_path / "list.txt").write_text("\n".join(["no tab", "", *lines]))
    back = _with_splits(spark, 1000)
    try:
        listing = LI.read_listings(spark, str(tmp_path))
        first = {r.video_id: r.title for r in LI.first_listing_per_video(listing).collect()}
        numbers = sorted(r.line_no for r in listing.collect())
    finally:
        back()
    assert first == {f"v{i:04d}": f"Title {i}" for i in range(300)} and numbers == list(range(2, 1502))
