"""Sources and sinks on small hand-written files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import dates, numbers, sections, text
from tallyframe.operators import incremental, quality
from tallyframe.sources import pages, reference, sinks

STUDY = "studies array<struct<id: string, hasResults: boolean, terms: array<struct<id: string, term: string>>, above: array<struct<id: string, term: string>>, arms: array<struct<label: string, type: string>>>>, totalCount long"


def test_paged_json_with_provenance(spark, tmp_path):
    page = {"studies": [{"id": "NCT00000001", "terms": [{"id": "D1", "term": "a"}], "above": [{"id": "D1", "term": "a"}, {"id": "D2", "term": "b"}], "arms": [{"label": "x", "type": "PLACEBO_COMPARATOR"}, {"label": "y", "type": None}]}, {"id": "bad"}, {"hasResults": True}], "totalCount": 3}
    (tmp_path / "page=00001.json").write_text(json.dumps(page, indent=1))
    (tmp_path / "page=00002.json").write_text(json.dumps({"studies": [{"id": "NCT00000002"}]}))
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "page=00001.json").write_text(json.dumps({"retrieved_at_utc": "2026-01-01T00:00:00Z"}))
    schema = spark.sql(f"select from_json('', '{STUDY}') as r").select("r.*").schema
    rows = pages.with_sidecar(pages.read_pages(spark, f"{tmp_path}/page=*.json", schema), pages.read_sidecars(spark, f"{tmp_path}/meta/*.json"))
    good, bad = pages.split_quarantine(pages.screen(rows, F.col("record").isNotNull(), F.col("record.id"), r"^NCT\d{8}$"))
    assert {(r["raw_page_reference"], r["raw_ordinal"], r["retrieved_at_utc"]) for r in good.collect()} == {("page=00001.json", 0, "2026-01-01T00:00:00Z"), ("page=00002.json", 0, None)}
    assert {r["reason"] for r in bad.collect()} == {"MISSING_ID", "INVALID_ID_FORMAT"}
    flat = good.select("record.*")
    arms = pages.entity(flat, ["id"], "arms", {"arm_label": "label", "arm_type": "type"}, "arm_ordinal").collect()
    assert [(r["arm_ordinal"], r["arm_label"]) for r in arms] == [(0, "x"), (1, "y")]
    mesh = {r["mesh_id"]: r["is_ancestor"] for r in pages.direct_and_ancestor(flat, ["id"], "terms", "above").collect()}
    assert mesh == {"D1": False, "D2": True}


def test_first_per_key_and_conflicts(spark):
    rows = spark.createDataFrame([("a", 2, "h"), ("a", 1, "h"), (None, 3, "x"), ("b", 1, "i")], "k string, pos int, h string")
    assert {(r["k"], r["pos"]) for r in pages.first_per_key(rows, "k", "h", ["pos"]).collect()} == {("a", 1), ("b", 1)}
    assert pages.dedup_stats(rows, "k", "h").first().asDict() == {"n_records": 4, "n_missing": 1, "n_duplicates": 1, "n_conflicts": 0}
    with pytest.raises(Exception, match="records differ for b"):
        pages.first_per_key(rows.unionByName(spark.createDataFrame([("b", 2, "j")], rows.schema)), "k", "h", ["pos"]).collect()


def test_demographics_denominators(spark):
    schema = "id string, baseline struct<denoms: array<struct<units: string, counts: array<struct<groupId: string, value: string>>>>, groups: array<struct<id: string, title: string>>, measures: array<struct<title: string, paramType: string, unitOfMeasure: string, denoms: array<struct<units: string, counts: array<struct<groupId: string, value: string>>>>, classes: array<struct<title: string, denoms: array<struct<units: string, counts: array<struct<groupId: string, value: string>>>>, categories: array<struct<title: string, measurements: array<struct<groupId: string, value: string, spread: string>>>>>>>>>"
    module = lambda n, u="Participants": [{"units": u, "counts": [{"groupId": "G1", "value": str(n)}]}]
    record = {"id": "a", "baseline": {"denoms": module(9, "eyes") + module(10), "groups": [{"id": "G1", "title": "arm"}], "measures": [
        {"title": "Sex", "paramType": "COUNT_OF_PARTICIPANTS", "unitOfMeasure": "Participants", "classes": [{"categories": [{"title": "F", "measurements": [{"groupId": "G1", "value": "4"}]}, {"title": "M"}]}]},
        {"title": "Race", "paramType": "NUMBER", "unitOfMeasure": "Participants", "denoms": module(8), "classes": [{"denoms": module(7), "categories": [{"title": "x", "measurements": [{"groupId": "G1", "value": "1"}]}]}]},
    ]}}
    row = spark.createDataFrame([(json.dumps(record),)], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")
    out = {(r["measure_title"], r["category_title"]): (r["group_denominator"], r["value_raw"], r["group_title"]) for r in pages.demographics(row, ["id"]).collect()}
    assert out == {("Sex", "F"): (10, "4", "arm"), ("Sex", "M"): (None, None, None), ("Race", "x"): (7, "1", "arm")}


def test_reference_files(spark, tmp_path):
    assert reference.gazetteer(spark, f"{tmp_path}/none.csv").count() == 0
    (tmp_path / "g.txt").write_text("USPS\tGEOID\tNAME\tINTPTLAT\tINTPTLONG   \nDE\t10001\tKent County\t39.1\t-75.5\nXX\t1\tNowhere\t99\t0\n")
    assert [tuple(r) for r in reference.gazetteer(spark, f"{tmp_path}/g.txt", "\t").collect()] == [("10001", "Kent County", "DE", 39.1, -75.5)]
    lines = spark.createDataFrame([("Title, of export",), ("State,FIPS,Rate,Low,High,Count,a,b,c",), ("US (1),00000,1,1,1,1,,,",), ('Delaware(7),10000,50.5,45,56,"1,234",x,y,z',), ("Utah(1),49000,20,1,2,*,x,y,z",), ("Notes: none",)], "value string")
    got = {r["state_name"]: (r["state_fips"], r["age_adjusted_rate_per_100k"], r["annual_cases"], r["registry_program"]) for r in reference.registry_export(lines, {"7": "NPCR", "1": "SEER"}).collect()}
    assert got == {"Delaware": ("10", 50.5, 1234, "NPCR"), "Utah": ("49", 20.0, None, "SEER")}
    with pytest.raises(Exception, match="suppressed count for F"):
        reference.shares(spark.createDataFrame([("F", None), ("M", 1)], "g string, n long"), "g", "n").collect()
    tracts = spark.createDataFrame([("c", "rural", 5), ("c", "metropolitan", 5), ("d", "rural", 1)], "county_fips string, ruca_group string, population long")
    counties, svi = spark.createDataFrame([("c",), ("d",)], "county_fips string"), spark.createDataFrame([("c", -999.0), ("d", 0.4)], "county_fips string, rpl_themes double")
    context = {r["county_fips"]: (r["svi_rpl_themes"], r["ruca_group"]) for r in reference.county_context(counties, svi, tracts, ["metropolitan", "rural"]).collect()}
    assert context == {"c": (None, "metropolitan"), "d": (0.4, "rural")}
    assert [r[0] for r in spark.createDataFrame([(1,), (10,), (99,)], "c int").select(reference.rural_urban(F.col("c"))).collect()] == ["metropolitan", "rural", None]


def test_sinks_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    sinks.write_run({"trials": rows, "empty": rows.where("false")}, str(tmp_path), "r1")
    sinks.write_run({"trials": rows.where("k = 1")}, str(tmp_path), "r2")
    sinks.write_run({"trials": rows.where("k = 2")}, str(tmp_path), "r2")
    whole = {run: sinks.read_run(spark, str(tmp_path), run) for run in ("r1", "r2")}
    assert {(run, r["k"]) for run, t in whole.items() for r in t["trials"].collect()} == {("r1", 1), ("r1", 2), ("r2", 2)}
    assert whole["r1"]["empty"].schema["k"].dataType == rows.schema["k"].dataType and whole["r1"]["empty"].count() == 0
    # a write that breaks off between two entities leaves the version before in force for both
    broken = rows.withColumn("v", F.raise_error(F.lit("disk is gone")).cast("string"))
    sinks.write_run({"trials": rows, "other": rows}, str(tmp_path), "r3")
    with pytest.raises(Exception, match="disk is gone"):
        sinks.write_run({"trials": rows.where("k = 1"), "other": broken}, str(tmp_path), "r3")
    assert [t.count() for t in sinks.read_run(spark, str(tmp_path), "r3").values()] == [2, 2]
    assert {r["entity"]: r["n_rows"] for r in sinks.run_stats(spark, str(tmp_path), "r3").collect()} == {"trials": 2, "other": 2}
    assert [json.loads(r[0]) for r in rows.select(sinks.audit_json("k", "v")).collect()] == [{"k": 1, "v": "a"}, {"k": 2, "v": None}]
    for _ in range(2):
        incremental.append_new(rows, f"{tmp_path}/log", "k")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    with pytest.raises(ValueError, match="schema changed"):
        incremental.append_new(rows.withColumn("z", F.lit(1)), f"{tmp_path}/log", "k")
    with pytest.raises(ValueError, match="rebuild has 1"):
        quality.guarded_rebuild(rows.limit(1), rows)
    sinks.write_summary(rows, f"{tmp_path}/summary")
    assert spark.read.option("header", True).csv(f"{tmp_path}/summary/csv").count() == 2


def test_functions_on_edges(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert one(text.normalize_text(F.lit("  O'Brien’s — Sjögren!! ")))[0] == "obriens sj gren" and one(text.normalize_text(F.lit("--")))[0] is None
    assert one(text.normalize_text_unicode(F.lit("Sjögren—X")))[0] == "sjögren x"
    assert [one(dates.parse_partial_date(F.lit(x)))[0] is None for x in ("2025", "2025-03", "2025-02-30", "soon", "")] == [False, False, True, True, True]
    assert one(numbers.wilson(F.lit(0), F.lit(0))[0])[0] is None and one(numbers.haversine_miles(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)))[0] is None
    assert [one(numbers.parse_age_years(F.lit(x)))[0] for x in ("18 Years", "6 Months", "N/A")] == [18.0, 0.5, None]


def test_sections_lose_nothing(spark):
    criteria = "Intro\nInclusion Criteria:\n- adults\n  * nested\nExclusion Criteria\n1. minors\n\nPatients must not:\n- smoke"
    row = spark.createDataFrame([(1, criteria), (2, ""), (3, "no headings\nat all"), (4, None)], "id long, t string").withColumn("s", sections.split_sections(F.col("t")))
    got = {r["id"]: (r["s"], r["back"]) for r in row.withColumn("back", sections.rebuilt(F.col("s"))).collect()}
    assert [s["kind"] for s in got[1][0]] == ["unclassified", "inclusion", "exclusion", "exclusion"] and got[1][1] == criteria
    assert got[2][1] == "" and got[3][0][0]["kind"] == "unclassified" and got[4][1] is None


def test_headings_within_lines_behind_bullets_and_uncertain_ones(spark):
    # text -> kinds of the sections, and how many items each has
    cases = {
        "Inclusion Criteria: adults over 18\nno fever": [("inclusion", 2)],
        "Adults with consent. Exclusion Criteria: pregnancy\n- smokers": [("unclassified", 1), ("exclusion", 2)],
        "* INCLUSION CRITERIA\n- a\n* Exclusion Criteria:\n- b\n- c": [("inclusion", 1), ("exclusion", 2)],
        "Key Inclusion Criteria:\n* No exclusion criteria\n* Meets inclusion criteria of part A": [("inclusion", 2)],
        "Extension Phase: Inclusion Criteria\na\nNon-inclusion criteria\nb": [("inclusion", 1), ("exclusion", 1)],
        "Inclusion Criteria (Part 1):\na\nCriteria for exclusion from the study were as follows:\nb": [("inclusion", 1), ("unclassified", 1)],
        "Inclusion Criteria\na\nGeneral Exclusion Criteria 2. History of disease\nb": [("inclusion", 1), ("unclassified", 1)],
        "**Inclusion Criteria:**\na\n**Exclusion Criteria**\nb": [("inclusion", 1), ("exclusion", 1)],
        "dose of 1.5 mg; inclusion: allowed\nsecond": [("unclassified", 2)],
        "Inclusion and Exclusion Criteria:\na": [("unclassified", 1)],
        "Eligibility\na\nPart 2: Exclusion Criteria\nb": [("inclusion", 1), ("exclusion", 1)],
        "1. Key exclusion criteria:\n2. Known exclusion of pregnancy\n- Eligibility was confirmed": [("exclusion", 2)],
        "Subjects will be excluded if:\na\nPatients should have:\nb\nPatients with fever": [("exclusion", 1), ("inclusion", 2)],
        "Exclusion criteria for the second cohort\na\nThe inclusion of children is allowed": [("exclusion", 2)],
        "Without exclusion criteria\nSee exclusion criteria 4 and 5 of the protocol": [("unclassified", 1), ("unclassified", 0)],
        "a) Inclusion\nb) Exclusion:\nc": [("unclassified", 1), ("exclusion", 1)],
        "Inclusion criteria (adults)\n" + "x" * 200 + " exclusion criteria " + "y" * 200: [("inclusion", 1)],
    }
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string").withColumn("l", sections.laid_out(F.col("t")))
    got = {r["t"]: r for r in rows.withColumn("s", sections.split_sections(F.col("l"))).withColumn("back", sections.rebuilt(F.col("s"))).collect()}
    for t, want in cases.items():
        assert [(s["kind"], len(s["items"])) for s in got[t]["s"]] == want, (t, got[t]["s"])
        assert got[t]["back"].split() == t.split()


def test_page_source_in_batches(spark, tmp_path):
    from tallyframe.sources import page_source

    page_source.register(spark)
    schema = spark.sql(f"select from_json('', '{STUDY}') as r").select("r.*").schema
    (tmp_path / "meta").mkdir()
    for k in range(1, 8):
        page = {"studies": [{"id": f"NCT{k}{i}", "terms": [{"id": "D1", "term": "ä\n"}], "extra": {"x": 1.5}} for i in range(k % 4)], "totalCount": 3}
        (tmp_path / f"page={k:05}.json").write_text(json.dumps(page, indent=k % 2 or None))
        if k % 2:
            (tmp_path / "meta" / f"page={k:05}.json").write_text(json.dumps({"retrieved_at_utc": f"2026-01-0{k}T00:00:00Z"}))
    (tmp_path / "notes.json").write_text("{}")
    read = lambda: spark.read.format("record_pages").option("meta", f"{tmp_path}/meta").option("pagesPerTask", 2).load(str(tmp_path))
    record = schema["studies"].dataType.elementType
    want = pages.with_sidecar(pages.read_pages(spark, f"{tmp_path}/page=*.json", schema), pages.read_sidecars(spark, f"{tmp_path}/meta/*.json"))
    columns = ["raw_page_reference", "raw_ordinal", "record", "retrieved_at_utc"]
    assert sorted(map(str, page_source.records_of(read(), record).select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    (tmp_path / "page=00005.json").write_text("broken")
    # a page outside the filter isn't opened, one inside gives a row for quarantine
    some = read().where("raw_page_reference > 'page=00002.json' and raw_page_reference <= 'page=00005.json'")
    assert sorted((r["raw_page_reference"][9], r["raw_ordinal"]) for r in some.collect() if r["record"]) == [("3", 0), ("3", 1), ("3", 2)]
    assert [(r["raw_ordinal"], r["record"]) for r in some.where("raw_page_reference = 'page=00005.json'").collect()] == [(None, None)]
    assert some.rdd.getNumPartitions() == 2 and read().where("raw_page_reference = 'none'").count() == 0


def test_page_source_as_a_stream_reads_no_page_twice(spark, tmp_path):
    from tallyframe.sources import page_source

    page_source.register(spark)
    (tmp_path / "in").mkdir()
    seen = []
    for run in range(3):
        for k in range(run * 5, run * 5 + 5):
            (tmp_path / "in" / f"page={k:05}.json").write_text(json.dumps({"studies": [{"id": k}, {"id": -k}]}))
        stream = spark.readStream.format("record_pages").option("pagesPerBatch", 2).load(f"{tmp_path}/in")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        seen += [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        query.stop()
    got = sorted((r["raw_page_reference"], r["raw_ordinal"], r["record"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((f"page={k:05}.json", i, json.dumps({"id": v})) for k in range(15) for i, v in enumerate((k, -k)))
    assert max(seen) == 4
