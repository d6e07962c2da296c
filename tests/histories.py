"""People whose histories each exercise one measurement rule."""

import datetime as dt

from spellframe.plans.config import HistoryConfig

HOME, SG, UK = "Harbour City", "Singapore", "United Kingdom"
CFG = HistoryConfig(cutoff="2026-08-31", last_complete_quarter="2026Q2", partial_quarter="2026Q3", home=HOME,
                    windows={"primary": ("2019Q4", "2023Q3"), "sensitivity": ("2018Q4", "2023Q3")})

POSITION = ("user_id string, position_id string, country string, metro_area string, startdate date, enddate date, "
            "rcid string, ultimate_parent_rcid string, role_k1500_v2 string, role_k17000_v3 string, seniority int")
USER = "user_id string, user_country string, updated_dt date"
RAW = "user_id string, position_id string, title_raw string"


def _day(text):
    return None if text is None else dt.date.fromisoformat(text + "-01")


class Book:
    def __init__(self):
        self.positions, self.raw, self.users = [], [], []

    def person(self, uid, country=HOME, seen="2026-05-15"):
        self.users.append((uid, country, dt.date.fromisoformat(seen)))

    def spell(self, uid, pid, start, end, country, title="Analyst", rcid="", parent=None, role3="r3a", raw=True):
        rcid = f"c{pid}" if rcid == "" else rcid
        metro = "harbour city metropolitan area" if country == HOME else None
        self.positions.append((uid, pid, country, metro, _day(start), _day(end), rcid, parent or rcid, "r1", role3, 2))
        if raw:
            self.raw.append((uid, pid, title))


def book() -> Book:
    b = Book()
    one = lambda uid, *spells, **kw: (b.person(uid, **kw), [b.spell(uid, *s[:4], **(s[4] if len(s) > 4 else {})) for s in spells])
    one("p01", ("101", "2015-01", None, HOME))
    one("p02", ("201", "2018-01", "2020-02", HOME), ("202", "2020-02", None, SG))
    one("p03", ("301", "2019-01", "2020-03", HOME), ("302", "2020-04", None, SG))
    one("p04", ("401", "2021-01", "2021-02", HOME))
    one("p05", ("501", "2016-01", None, HOME), ("502", "2020-06", None, SG, {"title": "Board Member"}))
    one("p06", ("200", "2017-01", None, HOME), ("1000", "2017-01", None, UK))
    one("p07", ("701", None, None, SG), ("702", "2015-01", None, HOME))
    one("p08", ("801", None, None, HOME))
    one("p09", ("901", "2015-01", None, HOME), ("902", "2026-09", None, SG))
    one("p10", ("1001", "2019-01", None, None), seen="2026-05-10")
    one("p11", ("1101", "2016-01", "2018-12", None), country=SG, seen="2017-03-01")
    one("p12", seen="2026-04-10")
    one("p13", seen="2026-08-20")
    one("p14", ("1401", "2018-01", None, HOME), seen="2021-02-01")
    one("p15", ("1501", "2015-01", "2020-12", HOME), ("1502", "2021-01", "2021-03", SG), ("1503", "2021-04", None, HOME))
    one("p16", ("1601", "2015-01", "2019-12", HOME), ("1602", "2020-01", "2021-12", UK), ("1603", "2022-01", None, HOME))
    one("p17", ("1701", "2015-01", "2020-06", HOME), ("1702", "2021-01", None, SG))
    one("p18", ("1801", "2015-01", "2023-03", SG), ("1802", "2023-04", None, HOME))
    one("p19", ("1901", "2022-01", None, HOME))
    big = "2400288101"
    one(big, ("9223372036854775807", "2015-01", "2020-12", HOME),
        ("-9223372036854775808", "2021-01", None, UK, {"role3": "r3dup"}), ("18446744073709551615", "2010-01", "2012-12", SG))
    b.positions.append(b.positions[-1])
    b.raw.append(b.raw[-1])
    one("p21", ("2101", "2015-01", "2020-12", HOME, {"rcid": "10", "parent": "100"}),
        ("2102", "2021-01", None, SG, {"rcid": "11", "parent": "100"}))
    one("p22", ("2201", "2015-01", "2020-12", HOME), ("2202", "2021-01", None, SG, {"rcid": None}))
    one("p23", ("2301", "2015-01", None, HOME), ("2301", "2015-01", None, SG, {"raw": False}))
    one("p24", ("2401", "2015-01", None, HOME, {"raw": False}))
    b.raw += [("p24", "2401", "Analyst"), ("p24", "2401", "Intern")]
    return b


def frames(spark):
    b = book()
    return {"positions": spark.createDataFrame(b.positions, POSITION).repartition(2),
            "positions_raw": spark.createDataFrame(b.raw, RAW), "users": spark.createDataFrame(b.users, USER),
            "cohort": spark.createDataFrame([(u[0],) for u in b.users], "user_id string"),
            "role_lookup_v3": spark.createDataFrame([("r3a", "x", "A"), ("r3dup", "x1", "B"), ("r3dup", "x2", "B")],
                                                    "role_k17000_v3 string, role_k150_v3 string, onet_title string")}
