import pytest

from lodestack.operators import catalogue, rarity


def test_names_are_checked_before_ranking(spark):
    artists = spark.createDataFrame([(1, None), (2, ""), (3, "c"), (4, "d"), (5, "e")], "artist_id long, artist_name string")
    by = spark.createDataFrame([(r, a) for a, n in ((1, 9), (2, 8), (3, 2), (4, 3), (5, 3)) for r in range(n)] + [(0, 3)], "release_id long, artist_id long")
    got = [tuple(r) for r in catalogue.artist_centrality(artists, by).collect()]
    assert got == [(1, "4", "d", 3), (2, "5", "e", 3), (3, "3", "c", 2)]
    with pytest.raises(ValueError):
        catalogue.artist_centrality(artists, by, 501)


def test_parents_floor_ties_and_absence(spark):
    shares = spark.createDataFrame([("a", "x", 0.2), ("a", "y", 0.1999), ("b", "y", 0.5), ("b", "x", 0.5), ("c", "x", 0.1)], "style string, genre string, share double")
    got = {(r["style"], r["genre"], r["is_dominant"]) for r in catalogue.style_parents(shares).collect()}
    assert got == {("a", "x", True), ("b", "x", True), ("b", "y", False)}


def test_undated_and_masterless_releases(spark):
    releases = spark.createDataFrame([(1, 1990, 1), (2, None, None), (3, 1990, 2)], "release_id long, year int, month int")
    styles = spark.createDataFrame([(1, "s"), (1, "s"), (2, "s"), (3, "s")], "release_id long, style string")
    genres = spark.createDataFrame([(1, "g"), (2, "g")], "release_id long, genre string")
    derived = spark.createDataFrame([(1, 7)], "release_id long, master_id long")
    assert [tuple(r) for r in catalogue.style_year_counts(releases, styles, derived).collect()] == [("s", 1990, 2, 1)]
    share = catalogue.style_genre_shares(styles, genres).first()
    assert (share["release_count"], share["style_release_count"]) == (2, 3)


def test_placeholders_follow_real_labels(spark):
    years = {1: (1900, 2000), 2: (1910, 2000), 3: (1920, 2000), 4: (1930, 2000), 5: (1990, 2000)}
    releases = spark.createDataFrame([(10 * k + i, y, 1) for k, v in years.items() for i, y in enumerate(v)] + [(99, None, None)], "release_id long, year int, month int")
    on = spark.createDataFrame([(10 * k + i, k) for k in years for i in range(2)] + [(99, 6)], "release_id long, label_id long")
    labels = spark.createDataFrame([(k, f"n{k}", k in (2, 5)) for k in range(1, 7)], "label_id long, label_name string, is_placeholder boolean")
    rank = lambda limit: {r["label_id"]: r["rank"] for r in catalogue.label_longevity(releases, on, labels, 2001, limit).collect()}
    assert rank(50) == {"1": 1, "3": 2, "4": 3, "2": 4, "5": 5}  # 6 is undated
    assert rank(2) == {"1": 1, "3": 2, "2": 3}
    row = catalogue.label_longevity(releases, on, labels, 2001).where("label_id = '1'").first()
    assert row["years_active"] == 100 and row["peak_decade"] == 1900 and row["still_active"]
    assert not catalogue.label_longevity(releases, on, labels, 2010).where("label_id = '1'").first()["still_active"]


def test_caps_and_order_of_landmarks_and_cotags(spark):
    styles = spark.createDataFrame([(i, "s") for i in range(60)] + [(i, f"t{i % 30:02d}") for i in range(60)], "release_id long, style string")
    derived = spark.createDataFrame([(i, i % 30) for i in range(60)], "release_id long, master_id long")
    masters = spark.createDataFrame([(0, None, None, None)], "master_id long, title string, year int, month int")
    marks = catalogue.style_landmarks(styles, derived, masters).where("style = 's'").orderBy("rank").collect()
    assert len(marks) == 25 and [m["master_id"] for m in marks[:3]] == ["0", "1", "10"] and marks[0]["title"] == "" and marks[0]["year"] is None
    tags = catalogue.style_cotags(styles).where("style = 's'").orderBy("rank").collect()
    assert len(tags) == 25 and tags[0]["other"] == "t00" and tags[0]["release_count"] == 2
    assert catalogue.style_cotags(styles).where("style = other").count() == 0


def test_anniversaries_are_milestones_of_the_month(spark):
    masters = spark.createDataFrame([(1, "a", 2000, 3), (2, None, 1975, 3), (3, "c", 2001, 3), (4, "d", 2000, 4), (5, "e", None, 3)], "master_id long, title string, year int, month int")
    got = {(r["master_id"], r["title"], r["anniversary"]) for r in catalogue.anniversaries(masters, 2025, 3).collect()}
    assert got == {("1", "a", 25), ("2", "", 50)}


def test_completeness_is_null_without_scorable_fields(spark):
    e = spark.createDataFrame([(1, 1990), (2, None)], "id long, year int")
    assert catalogue.completeness(e, "m", None, "year IS NOT NULL", None, None).first()["completeness_pct"] == 50
    assert catalogue.completeness(e, "a", "id > 0", None, None, None).first()["completeness_pct"] is None
    assert catalogue.completeness(e.limit(0), "m", None, "year IS NOT NULL", None, None).first()["completeness_pct"] is None


def test_counts_of_parts_add_up(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 2, 0) for i in range(20)], "release_id long, artist long, label long, genre long")
    whole = {tuple(r) for r in rarity.quality_counts(rows).collect()}
    parts = rarity.quality_counts(rows.where("release_id < 7")).union(rarity.quality_counts(rows.where("release_id >= 7")))
    assert {tuple(r) for r in parts.groupBy("signal", "value").sum("releases").collect()} == whole
    score = {(r["signal"], r["value"]): r["score"] for r in rarity.scarcity(rarity.quality_counts(rows)).collect()}
    assert score["label", 1] == 0 and score["label", 0] == 0.5 and score["genre", 0] == 0


def test_missing_ids_are_empty_not_null(spark):
    releases = spark.createDataFrame([(1, 1990, 1), (2, 1991, 1)], "release_id long, year int, month int")
    by = spark.createDataFrame([(1, 5), (1, 3)], "release_id long, artist_id long")
    on = spark.createDataFrame([], "release_id long, label_id long")
    genres = spark.createDataFrame([(1, "g")], "release_id long, genre string")
    got = {r["release_id"]: r for r in rarity.release_rarity(releases, rarity.quality_signals(releases, by, on, genres), by, on).collect()}
    assert got["1"]["artist_ids"] == [3, 5] and got["2"]["artist_ids"] == [] and got["2"]["label_ids"] == [] and got["1"]["pressing_scarcity"] is None
    assert got["1"]["media_families"] == [] and got["1"]["family_signals"] == {}
