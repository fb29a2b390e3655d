import numpy as np
import pandas as pd
import pytest

from homescore.config import DEVICE_KEYS, KpiRules
from homescore.operators import kpi
from tests.conftest import plan, rows

SCHEMA = (
    "rowkey string, rk_row_sn string, serial_num string, station_mac string, parent_id string,"
    " sdcd_signal_strength bigint, sdcd_tx_link_rate bigint, sdcd_connect_type string,"
    " byte_send bigint, byte_received bigint"
)


def reading(home, mac, rssi, rate=100, band="5G", parent="P", sent=10, received=10):
    return (f"AAAA-{home}-202401010000", f"AAAA-{home}", home, mac, parent, rssi, rate, band, sent, received)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def by_mac(df, column):
    return {r["station_mac"]: r[column] for r in df.collect()}


def test_thresholds_and_minimum_readings(spark):
    data = [reading("h", "m36", -76 if i < 9 else -75) for i in range(36)]
    data += [reading("h", "m35", -90) for _ in range(35)]
    data += [reading("h", "b24", -79 if i % 2 else -78, band="2.") for i in range(40)]
    data += [reading("h", "b6", -71 if i % 4 == 0 else -70, band="6G") for i in range(40)]
    poor = by_mac(kpi.poor_rssi(kpi.device_kpis(frame(spark, data))), "poor_rssi")
    assert poor == {"m36": 25.0, "b24": 50.0, "b6": 25.0}


def test_rates_outside_the_valid_range_do_not_count(spark):
    rates = [6, 7, 12, 24, 64, 65, 2499, 2500, None]
    kpis = kpi.device_kpis(frame(spark, [reading("h", "m", -60, r) for r in rates]))
    row = kpi.poor_phyrate(kpis).first()
    assert row["total_count"] == 4
    assert row["avg_phyrate"] == pytest.approx((7 + 64 + 65 + 2499) / 4)
    assert row["poor_phyrate"] == 50.0


def test_constant_signal_is_dropped_only_when_strict(spark):
    data = frame(spark, [reading("h", "same", -60)] * 40 + [reading("h", "varied", -60 - i % 3) for i in range(40)])
    assert by_mac(kpi.stationarity(kpi.device_kpis(data)), "stationarity") == {"varied": 1}
    lenient = kpi.device_kpis(data, KpiRules(strict=False))
    assert set(by_mac(kpi.stationarity(lenient), "stationarity")) == {"same", "varied"}


def test_absent_parent_is_kept_among_parents(spark):
    data = [reading("h", "m", -60, parent=p) for p in ("A", None, "A")]
    parents = kpi.device_kpis(frame(spark, data)).first()["parents"]
    assert sorted([p.parent_id for p in parents], key=str) == ["A", None]


def random_data(seed=7, devices=40):
    rng = np.random.default_rng(seed)
    data = []
    for d in range(devices):
        base, spread = int(rng.integers(-85, -45)), int(rng.integers(0, 25))
        # One device holds about a third of all readings.
        for _ in range(1500 if d == 0 else int(rng.integers(30, 120))):
            rssi = None if rng.random() < 0.05 else base - int(rng.integers(0, spread + 1))
            data.append(
                reading(
                    f"h{d % 7}",
                    f"m{d}",
                    rssi,
                    int(rng.choice([5, 6, 7, 12, 24, 40, 64, 65, 300, 2499, 2500])),
                    str(rng.choice(["2.", "5G", "6G"])),
                    f"P{int(rng.integers(0, 3))}",
                )
            )
    return data


def disc(values, p):
    ordered = np.sort(values)
    return ordered[max(int(np.ceil(p * len(ordered) - 1e-9)), 1) - 1]


def test_one_pass_equals_separate_passes(spark):
    data = random_data()
    got = {r["station_mac"]: r for r in kpi.device_kpis(frame(spark, data)).collect()}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    pdf = pd.DataFrame(data, columns=names)
    limits = {"2.": -78, "5G": -75, "6G": -70}
    assert len(got) == pdf.station_mac.nunique()
    for mac, group in pdf.groupby("station_mac"):
        heard = group.dropna(subset=["sdcd_signal_strength"])
        signal = heard.sdcd_signal_strength.to_numpy()
        weak = (signal < heard.sdcd_connect_type.map(limits).to_numpy()).sum()
        rate = group.sdcd_tx_link_rate
        valid = rate[(rate > 6) & (rate < 2500) & ~rate.isin([12, 24])]
        p3, p10, p50, p90 = (disc(signal, p) for p in (0.03, 0.1, 0.5, 0.9))
        r = got[mac]
        assert r["n_rssi"] == len(heard) and r["n_phy"] == len(valid)
        assert r["poor_rssi"] == pytest.approx(100 * weak / len(heard))
        assert r["poor_phyrate"] == pytest.approx(100 * (valid < 65).mean())
        assert r["avg_phyrate"] == pytest.approx(valid.mean())
        assert r["kept"] == bool((signal > min(p10 - 2 * (p90 - p10), p3)).any())
        assert r["stationarity"] == int(p90 - p50 <= 5)


def outlier_rows(pdf):
    """The pairwise rule written out: of two bounds, use the one that drops fewer rows."""
    x = pdf.sdcd_signal_strength.to_numpy()
    q10, q90, p3, med = np.percentile(x, [10, 90, 3, 50])
    by_iqr, by_low = x >= q10 - 2 * (q90 - q10), x >= p3
    keep = by_iqr if (~by_iqr).sum() < (~by_low).sum() else by_low
    return keep.sum(), int(abs(q90 - med) <= 5)


def test_exact_stationarity_rows(spark):
    data = [r for r in random_data(11) if r[5] is not None]
    out = kpi.stationarity_rows(frame(spark, data)).groupBy("station_mac", "stationarity").count().collect()
    got = {r["station_mac"]: (r["count"], r["stationarity"]) for r in out}
    pdf = pd.DataFrame(data, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    assert got == {mac: outlier_rows(group) for mac, group in pdf.groupby("station_mac")}


def test_one_scan_and_shuffles_of_counts_only(spark):
    text = plan(kpi.device_kpis(frame(spark, [reading("h", "m", -60)])))
    physical = text[text.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning") == 2
    assert physical.count("Scan ExistingRDD") + physical.count("LocalTableScan") == 1
    assert rows(frame(spark, [reading("h", "m", -60)]), *DEVICE_KEYS)


def test_readings_meet_no_object_aggregate_and_null_keys_keep_no_parents(spark):
    telemetry = frame(spark, [reading("h", "m", -60 - i % 3, parent=f"p{i % 2}") for i in range(40)] + [reading("h", None, -60, parent=f"q{i}") for i in range(50)])
    kpis = kpi.device_kpis(telemetry)
    got = {r.station_mac: r for r in kpis.collect()}
    assert [p.parent_id for p in sorted(got["m"].parents)] == ["p0", "p1"] and got[None].parents == []
    assert (got["m"].n_rssi, got[None].n_rssi) == (40, 50)
    physical = kpis._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = {k: len(line) - len(line.lstrip(" :+-")) for k, line in enumerate(physical)}
    objects = [k for k, line in enumerate(physical) if "ObjectHashAggregate" in line or "SortAggregate" in line]
    hashes = [k for k, line in enumerate(physical) if " HashAggregate" in line or line.lstrip(" :+-").startswith("HashAggregate")]
    assert objects and hashes and max(depth[k] for k in objects) < min(depth[k] for k in hashes)
