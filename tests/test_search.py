"""Search and detail on hand-made registry tables, against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from test_nearest import miles

from tallyframe.plans import reports, search
from tallyframe.plans.search import Wanted

R = random.Random(11)
DAY = dt.date(2025, 1, 1)
TRIALS = [
    (f"N{i:03}", R.choice(["Alpha fever", "beta%_x", "Gamma"]), R.choice(["RECRUITING", "Completed", None]), R.choice(["PHASE1", "PHASE1/PHASE2", None]), R.choice([None, 12.0, 18.0]), R.choice([None, 60.0, 75.0]),
     R.choice([None, "ALL", "FEMALE", "unknown"]), R.choice([None, True, False]), R.choice([None, [], ["ADULT"], ["CHILD", "ADULT"]]), R.choice([None, DAY, DAY + dt.timedelta(R.randrange(5))]),
     R.choice([None, DAY + dt.timedelta(R.randrange(9))]))
    for i in range(80)
]
SITES = [
    (f"N{R.randrange(85):03}", j, f"f{j}", R.choice(["springfield", "york", None]), R.choice(["IL", "PA"]), R.choice(["02139-1", "99999", None]), *R.choice([(None, None), (40.0 + j % 7, -75.0), (None, -70.0)]), R.choice(["Recruiting", "NOT_YET_RECRUITING", "COMPLETED", None]))
    for j in range(200)
]
ZIPS = [("02139", 42.4, -71.1), ("10001", 40.7, -74.0)]
CITIES = [("IL", "springfield", "springfield", 39.8, -89.6), ("IL", "springfield city", "springfield", 38.0, -88.0), ("PA", "york", None, 39.9, -76.7)]
SPONSORS = [(f"N{i:03}", R.choice(["INDUSTRY", "NIH"]), R.choice(["lead_sponsor", "collaborator"])) for i in range(0, 80, 2) for _ in range(2)]
INTERVENTIONS = [(f"N{i:03}", R.choice(["Drug", "DEVICE"])) for i in range(0, 80, 3)]
CONDITIONS = [(f"N{i:03}", f"raw {i % 5}", R.choice(["fever group", None]), "norm") for i in range(70)]
TERMS = [(f"N{i:03}", "D001", "Fever") for i in range(0, 80, 7)]


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    trials = make(TRIALS, "nct_id string, brief_title string, overall_status string, phase string, min_age_years double, max_age_years double, sex_eligibility string, accepts_healthy_volunteers boolean, std_age_groups array<string>, start_date date, last_update_post_date date")
    sites = make(SITES, "nct_id string, location_ordinal long, facility_name string, city string, state_normalized string, zip_code string, latitude double, longitude double, location_status string")
    place = make(CITIES, "state string, city_name string, city_name_stripped string, latitude double, longitude double")
    sites = search.sited(sites.selectExpr("*", "city AS city_normalized"), make(ZIPS, "zip string, latitude double, longitude double"), place).cache()
    sponsors, conditions = make(SPONSORS, "nct_id string, sponsor_class string, sponsor_role string"), make(CONDITIONS, "nct_id string, condition_raw string, condition_group string, condition_normalized string")
    return trials, sites, sponsors, make(INTERVENTIONS, "nct_id string, intervention_type string"), conditions, make(TERMS, "nct_id string, mesh_id string, mesh_term string")


def spot(s):
    """Coordinates of a site and where they come from."""
    if s[6] is not None and s[7] is not None:
        return (s[6], s[7]), "registry"
    for z in ZIPS:
        if (s[5] or "")[:5] == z[0]:
            return z[1:], "zip"
    return min(((c[3:], "city") for c in CITIES if c[0] == s[4] and s[3] is not None and s[3] in c[1:3]), default=(None, None))


def plain(w: Wanted):
    out = []
    for t in TRIALS:
        key, title, status, phase, low, high, sex, healthy, ages, start, updated = t
        open_ = [(miles(w.place, spot(s)[0]) if w.place and spot(s)[0] else None, s[1], spot(s)[1] not in ("registry", None)) for s in SITES if s[0] == key and (s[8] or "").upper() in search.OPEN_SITES and (w.place is None or spot(s)[0])]
        best = min(open_, default=None, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        distance = best[0] if best else None
        told = (w.condition or "").lower()
        hit = told in title.lower() or any(c[0] == key and any(told in (x or "").lower() for x in c[1:]) for c in CONDITIONS) or any(m[0] == key and told in (m[1].lower(), m[2].lower()) for m in TERMS)
        rules = [
            w.status is None or (status or "").upper() == w.status.upper(), w.phase is None or w.phase.upper() in (phase or "").split("/"),
            w.min_age is None or high is None or high >= w.min_age, w.max_age is None or low is None or low <= w.max_age,
            w.sex is None or w.sex.upper() == "ALL" or (sex or "ALL").upper() in ("ALL", "UNKNOWN", w.sex.upper()), w.healthy_volunteers is None or healthy in (None, w.healthy_volunteers),
            w.std_age_group is None or ages is None or w.std_age_group in ages, w.sponsor_class is None or any(s[0] == key and s[1] == w.sponsor_class for s in SPONSORS),
            w.intervention_type is None or any(i[0] == key and i[1].upper() == w.intervention_type.upper() for i in INTERVENTIONS), w.condition is None or hit,
            w.place is None or distance is not None and distance <= (w.radius_miles or 20_000), w.updated_since is None or updated is not None and str(updated) >= w.updated_since,
        ]
        if all(rules):
            out.append((key, {"start_date": start, "last_update_post_date": updated, "distance_miles": distance}[search.SORTS[w.sort][0]], best[1] if best else None))
    up = search.SORTS[w.sort][1]
    known, rest = [r for r in out if r[1] is not None], [r for r in out if r[1] is None]
    return sorted(known, key=lambda r: (r[1], r[0]), reverse=not up) + sorted(rest, key=lambda r: r[0], reverse=not up)


CASES = [
    Wanted(), Wanted(status="recruiting", phase="phase2", sort="updated"), Wanted(min_age=70, max_age=15, sort="start_date"), Wanted(sex="male", healthy_volunteers=False, std_age_group="CHILD", sort="-start_date"),
    Wanted(sponsor_class="NIH", intervention_type="drug"), Wanted(condition="%_"), Wanted(condition="FEVER", updated_since="2025-01-04"), Wanted(place=(40.7, -74.0), sort="distance"),
    Wanted(place=(42.4, -71.1), radius_miles=150.0, sort="distance", sex="all"), Wanted(condition="d001", place=(0.0, 0.0), sort="-updated"),
]


@pytest.mark.parametrize("wanted", CASES[1:])
def test_search_against_plain_python(tables, wanted):
    want = plain(wanted)
    got = search.build_search(*tables, Wanted(**{**wanted.__dict__, "size": 200})).collect()
    assert {r["nct_id"] for r in got} == {w[0] for w in want} and all(r["total"] == len(want) for r in got)
    where = {s[2]: s[1] for s in SITES}
    near = {w[0]: w[2] for w in want}
    for r in got:
        assert where.get(r["nearest_facility_name"]) == near[r["nct_id"]]
        assert r["sponsor_class"] == min((s[1] for s in SPONSORS if s[0] == r["nct_id"] and s[2] == "lead_sponsor"), default=None)
        assert sorted(r["conditions"] or []) == sorted({c[1] for c in CONDITIONS if c[0] == r["nct_id"]})


@pytest.mark.parametrize("sort", search.SORTS)
def test_pages_follow_each_other(tables, sort):
    place = (40.7, -74.0) if sort == "distance" else None
    want, seen, after = plain(Wanted(sort=sort, place=place)), [], None
    rows = search.build_search(*tables, Wanted(sort=sort, place=place, size=200)).cache()
    column = search.SORTS[sort][0]
    while True:
        page = search.page_of(rows, Wanted(sort=sort, size=9, after=after)).collect()
        seen += [r["nct_id"] for r in page[:9]]
        if len(page) < 10:
            break
        after = (page[8][column], page[8]["nct_id"])
    assert seen == [w[0] for w in want] and len(want) > 9


def test_details_have_sites_with_distances(tables):
    trials, sites, *_ = tables
    place = (40.7, -74.0)
    child = search.build_site_details(sites, place)
    columns = ["facility_name", "coordinate_source", "site_latitude", "site_longitude", "distance_miles", "location_status"]
    got = reports.build_detail_documents(trials.select("nct_id"), "nct_id", {"sites": (child, ["location_ordinal"], columns)}).collect()
    for r in got:
        own = [s for s in SITES if s[0] == r["nct_id"]]
        assert [x["facility_name"] for x in r["sites"]] == [s[2] for s in own]
        for x, s in zip(r["sites"], own, strict=True):
            at, source = spot(s)
            assert x["coordinate_source"] == source and (at is None or (x["site_latitude"], x["site_longitude"]) == tuple(at))
            assert x["distance_miles"] == (None if at is None else pytest.approx(miles(place, at), abs=0.051))
    assert {x["coordinate_source"] for r in got for x in r["sites"]} == {"registry", "zip", "city", None}
