"""The queries of `queries.py` in ANSI SQL, written step by step as the jobs define them."""

from __future__ import annotations

from homescore.config import FEATURE_BINS, FEATURE_METRICS, INCREMENT_EDGES, MODEL_FEATURES, SWEEP_FEATURES, WINDOW_FEATURES

from homescore.operators.score import ROLLUP_B, ROLLUP_C


def rnd(expr: str, places: int = 4) -> str:
    """Round half up on the printed value, as the engine under test does."""
    return f"round((({expr})::double)::varchar::decimal(38,16), {places})::double"


def weighted(value: str) -> str:
    """Sum over a home of a figure times the weight, exact to 14 places whatever the order of rows."""
    return f"sum(({value} * weights)::decimal(28,14))"


def ctes(*names: str) -> str:
    """WITH clause holding the named steps and everything they build on."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        for other in STEPS:
            if other != name and f"{{{other}}}" in STEPS[name]:
                add(other)
        needed.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{n} as ({_fill(STEPS[n])})" for n in needed) + "\n"


def _fill(sql: str) -> str:
    for other in STEPS:
        sql = sql.replace(f"{{{other}}}", other)
    return sql


def texts(column: str) -> str:
    """A list column as sorted, distinct, joined text."""
    return f"array_to_string(list_sort(list_distinct({column}::varchar[])), ',')"


def joined(column: str) -> str:
    """All values of a group as sorted, distinct, joined text; '' for none."""
    return f"coalesce(string_agg(distinct {column}::varchar, ',' order by {column}::varchar), '')"


def lenient_long(text: str) -> str:
    return (
        f"case when regexp_full_match(trim({text}), '[+-]?[0-9]+(\\.[0-9]*)?')"
        f" then trunc(trim({text})::double)::bigint end"
    )


KEYS = "rowkey, rk_row_sn, serial_num, station_mac"
RATE_OK = "sdcd_tx_link_rate > 6 and sdcd_tx_link_rate < 2500 and sdcd_tx_link_rate not in (12, 24)"
WEAK = (
    "(sdcd_connect_type = '2.' and sdcd_signal_strength < -78)"
    " or (sdcd_connect_type = '5G' and sdcd_signal_strength < -75)"
    " or (sdcd_connect_type = '6G' and sdcd_signal_strength < -70)"
)
SN = "'SN' || lpad({}::varchar, 9, '0')"
HOME = "'R' || lpad(({0} % 1000)::varchar, 3, '0') || '-SN' || lpad({0}::varchar, 9, '0')"


def on_keys(a: str, b: str, keys: str = KEYS) -> str:
    return " and ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


def _kpi_steps(suffix: str, source: str, keys: str = KEYS, min_readings: int = 36) -> dict[str, str]:
    """rssi / phy / stationary steps over one telemetry source."""
    return {
        f"rssi{suffix}": f"""
            select *, 100.0::double * n_weak / total_count as poor_rssi, ln(byte_send + byte_received) as volume
            from (select {keys}, count(*) as total_count, count(*) filter (where {WEAK}) as n_weak,
                    avg(sdcd_signal_strength) filter (where sdcd_connect_type = '2.') as avg_sig_strength_cat1,
                    avg(sdcd_signal_strength) filter (where sdcd_connect_type = '5G') as avg_sig_strength_cat2,
                    avg(sdcd_signal_strength) filter (where sdcd_connect_type = '6G') as avg_sig_strength_cat3,
                    sum(byte_send)::bigint as byte_send, sum(byte_received)::bigint as byte_received
                  from {{{source}}} where sdcd_signal_strength is not null group by {keys})
            where total_count >= {min_readings}""",
        f"phy{suffix}": f"""
            select {keys}, count(*) as total_count, avg(sdcd_tx_link_rate) as avg_phyrate,
                   100.0::double * count(*) filter (where sdcd_tx_link_rate < 65) / count(*) as poor_phyrate
            from {{{source}}} where {RATE_OK} group by {keys}""",
        f"pct{suffix}": f"""
            select {keys}, quantile_disc(sdcd_signal_strength, 0.03) as p3,
                   quantile_disc(sdcd_signal_strength, 0.1) as p10,
                   quantile_disc(sdcd_signal_strength, 0.5) as p50,
                   quantile_disc(sdcd_signal_strength, 0.9) as p90
            from {{{source}}} group by {keys}""",
        f"stationary{suffix}": f"""
            select {", ".join("t." + k.strip() for k in keys.split(","))},
                   max(case when p90 - p50 <= 5 then 1 else 0 end) as stationarity
            from {{{source}}} t join {{pct{suffix}}} p on {on_keys("t", "p", keys)}
            where sdcd_signal_strength > least(p10 - 2 * (p90 - p10), p3)
            group by {", ".join("t." + k.strip() for k in keys.split(","))}""",
        f"parents{suffix}": f"select distinct {KEYS}, parent_id from {{{source}}}",
    }


def _weights_b(suffix: str) -> dict[str, str]:
    return {
        f"label_b{suffix}": f"""
            select p.*, s.stationarity,
                   case when avg_phyrate <= 20.718 and stationarity = 1 then avg_phyrate / 20.718 else 1.0 end::double
                     as label
            from {{phy{suffix}}} p join {{stationary{suffix}}} s on {on_keys("p", "s")}""",
        f"first_b{suffix}": f"""
            select {KEYS}, stationarity, {rnd("avg_phyrate")} as avg_phyrate, {rnd("poor_phyrate")} as poor_phyrate,
                   {rnd("label / sum(label) over (partition by serial_num)")} as w
            from {{label_b{suffix}}}""",
        f"weights_b{suffix}": f"""
            select f.* exclude (w), {rnd("r.poor_rssi")} as poor_rssi,
                   {rnd("w / sum(w) over (partition by f.serial_num)")} as weights
            from {{first_b{suffix}}} f join {{rssi{suffix}}} r on {on_keys("f", "r")}""",
    }


def _weights_c(suffix: str) -> dict[str, str]:
    return {
        f"share_c{suffix}": f"""
            select *, volume / nullif(sum(volume) over (partition by serial_num), 0) as w from {{rssi{suffix}}}""",
        f"weights_c{suffix}": f"""
            select r.*, p.avg_phyrate, p.poor_phyrate, s.stationarity,
                   case when avg_phyrate < 20.718 and stationarity = 1 then w * avg_phyrate / 20.718 else w end
                     as weights
            from {{share_c{suffix}}} r join {{phy{suffix}}} p on {on_keys("r", "p")}
            join {{stationary{suffix}}} s on {on_keys("r", "s")}""",
    }


SETS = ("RouExt_mac", "dg_model", "parent_mac", "firmware", "parent_id", "Rou_Ext")


def _rollup(weights: str, parents: str, features: tuple[str, ...]) -> str:
    keys = ", ".join("w." + k.strip() for k in KEYS.split(","))
    return f"""
        select w.serial_num, mdn, cust_id, w.rowkey, w.rk_row_sn, w.station_mac,
               {", ".join(f"any_value(w.{f}) as {f}" for f in features)},
               list_sort(coalesce(list(distinct RouExt_mac) filter (where RouExt_mac is not null), [])) as RouExt_mac,
               list_sort(coalesce(list(distinct dg_model) filter (where dg_model is not null), [])) as dg_model,
               list_sort(coalesce(list(distinct parent_mac) filter (where parent_mac is not null), [])) as parent_mac,
               list_sort(coalesce(list(distinct firmware) filter (where firmware is not null), [])) as firmware,
               list_sort(coalesce(list(distinct parent_id) filter (where parent_id is not null), [])) as parent_id,
               list_sort(list(distinct case when parent_mac is not null then 1 else 0 end)) as Rou_Ext
        from {{{weights}}} w join {{{parents}}} p on {on_keys("w", "p")}
        left join {{identity}} i on i.serial_num = w.serial_num
        left join {{groups}} g on g.dg_rowkey = w.rk_row_sn and g.RouExt_mac = p.parent_id
        group by {keys}, mdn, cust_id"""


def _home(devices: str) -> str:
    return f"""
        select serial_num, mdn, cust_id, count(*) as num_station,
               {rnd(weighted("poor_rssi"))} as poor_rssi,
               {rnd(weighted("poor_phyrate"))} as poor_phyrate,
               {rnd(weighted("device_score"))} as home_score,
               list(distinct dg_model) as dg_model, list(distinct Rou_Ext) as Rou_Ext
        from {{{devices}}} group by serial_num, mdn, cust_id"""


def _per_model(homes: str, model: str = "flatten(dg_model)", more: str = "num_station,") -> str:
    return f"""
        select serial_num, mdn, cust_id, {more} poor_rssi, poor_phyrate, home_score,
               {texts(model)} as dg_model, {texts("flatten(Rou_Ext)")} as Rou_Ext,
               unnest(list_distinct({model})) as dg_model_indiv
        from {homes}"""


ROOT = "Station_Data_connect_data_b_"


def _in_days(start: str, count: int) -> str:
    return f"date between date '{start}' and date '{start}' + {count - 1}"


#: Subscriber maps of some days.
_SNAPSHOTS = "select distinct date, serial_num, cust_id from device_days where day(date) in (2, 3, 6, 11, 14)"

#: Events with the reason why their line cannot be used.
_ODD = """
    select ts::date::varchar as day, case when event_id % 11 = 0 or event_id % 13 = 0 then 'malformed'
           when event_id % 17 = 0 then 'no user_id' when event_id % 19 = 0 then 'too large' end as odd from events"""


def _starts(first: str, count: int = 10) -> str:
    return f"(select date '{first}' + i::int as start from range({count}) s(i))"


def _device_window(source: str, features=WINDOW_FEATURES, no_median=("device_score",), volume=False, n=5) -> str:
    figures = [f"{rnd(f'avg({f})')} as {f}" for f in features]
    figures += [f"{rnd(f'quantile_disc({f}, 0.5)')} as median_{f}" for f in features if f not in no_median]
    if volume:
        figures.append(f"{rnd('sum(exp(volume))')} as total_volume")
    figures.append("count(*) as count")
    lowest = "list_avg(list_sort(list(device_score) filter (where device_score is not null))[1:%d])" % n
    figures.append(f"{rnd(lowest)} as lowest_n_scores")
    return f"select serial_num, {', '.join(figures)} from {source} group by serial_num"


def _before_after(start: str, after: str, count: int, cohort: str | None) -> str:
    member = f" and serial_num in (select serial_num from {cohort})" if cohort else ""
    return f"""
        select b.* rename (device_score as avg_device_score, lowest_n_scores as before_lowest_n_scores),
               before_home_score, target_avg_device_score, target_lowest_n_scores, after_home_score
        from ({_device_window(f"(select * from {{device_days}} where {_in_days(start, count)}{member})", volume=True)}) b
        join (select serial_num, {rnd("avg(home_score)")} as before_home_score from {{home_days}}
              where {_in_days(start, count)}{member} group by 1) hb using (serial_num)
        join (select serial_num, device_score as target_avg_device_score, lowest_n_scores as target_lowest_n_scores
              from ({_device_window(f"(select * from {{device_days}} where {_in_days(after, count)}{member})",
                                    ("device_score",))})) a using (serial_num)
        join (select serial_num, {rnd("avg(home_score)")} as after_home_score from {{home_days}}
              where {_in_days(after, count)}{member} group by 1) ha using (serial_num)"""


def _phase(start: str, count: int, flag: int, first: int = 0) -> str:
    days = f"date between date '{start}' + {first} and date '{start}' + {count - 1}"
    return (
        f"(select serial_num from {{device_days}}, unnest(Rou_Ext) as u(flag) where {days}"
        f" group by serial_num having max(flag) = {flag})"
    )


RULE = "avg_phyrate < 400 and poor_phyrate > 6 and poor_rssi > 20 and count > 10"
RULE_200 = "avg_phyrate < 400 and poor_phyrate > 6 and poor_rssi > 20 and count * 10 > 200"


def _all_there(names) -> str:
    return " and ".join(f"{n} is not null" for n in names)


def _is_test(key: str) -> str:
    return f"(('0x' || substr(md5({key}::varchar || ':42'), 1, 8))::bigint) % 5 = 0"


_LINE = f"""
    select *, {SN.format("l_suppkey")} as serial_num, {HOME.format("l_suppkey")} as rk_row_sn,
           {HOME.format("l_suppkey")} || '-202401010000' as rowkey,
           'M' || (l_suppkey * 100 + l_linenumber * 10 + (l_linestatus = 'F')::int) as station_mac,
           'P' || l_partkey as parent_id,
           case when l_linenumber % 2 = 0 then -45 - l_quantity else -66 - floor(l_quantity / 4) end::bigint as rssi,
           case when l_linenumber = 3 then 7 + l_partkey % 20 else floor(l_extendedprice / 40) end::bigint as rate,
           floor(l_extendedprice)::bigint as sent, (l_quantity * 100)::bigint as received
    from lineitem"""

def _devices_a(suffix: str) -> str:
    return f"""
        select i.mdn, i.cust_id, w.*, g.RouExt_mac, g.dg_model, g.parent_mac, g.firmware,
               case when g.parent_mac is not null then 1 else 0 end as Rou_Ext,
               (100 - poor_rssi) * 0.4::double + (100 - poor_phyrate) * 0.6::double as device_score
        from (select p.serial_num, p.rowkey, p.rk_row_sn, p.station_mac, p.parent_id,
                     p.avg_phyrate, p.poor_phyrate, p.weights, r.poor_rssi
              from (select {KEYS}, parent_id, {rnd("avg_phyrate")} as avg_phyrate,
                           {rnd("poor_phyrate")} as poor_phyrate,
                           {rnd("label * 100 / sum(label) over ()")} as weights
                    from (select *, case when avg_phyrate >= 20.718 then 1.0 else avg_phyrate / 20.718 end::double
                                   as label from {{phy{suffix}}})) p
              join {{rssi{suffix}}} r on {on_keys("p", "r", KEYS + ", parent_id")}) w
        join {{everyone}} i on i.serial_num = w.serial_num
        left join {{groups}} g on g.dg_rowkey = w.rk_row_sn and g.RouExt_mac = w.parent_id"""


STEPS: dict[str, str] = {
    "lines": _LINE,
    "tel": f"""
        select {KEYS}, parent_id, rssi as sdcd_signal_strength, rate as sdcd_tx_link_rate,
               case l_returnflag when 'A' then '2.' when 'N' then '5G' else '6G' end as sdcd_connect_type,
               sent as byte_send, received as byte_received
        from {{lines}}""",
    "history": f"""
        select rowkey, epoch_ms(l_shipdate) + l_orderkey % 1000 as ts, station_mac as {ROOT}station_mac,
               parent_id as {ROOT}parent_id,
               case when l_linenumber = 7 and l_linestatus = 'O' then 'Ethernet' when l_returnflag = 'A' then '2.4GHz'
                    when l_returnflag = 'N' then '5GHz' else '6GHz' end as {ROOT}connect_type,
               case when l_discount = 0.01 then rate || '.5Mbps' when l_discount = 0.02 then rate || ' Mbps'
                    when l_discount = 0.03 then 'autoMbps' else rate || 'Mbps' end as {ROOT}tx_link_rate,
               trunc(rate + l_quantity)::bigint || 'Mbps' as {ROOT}link_rate,
               case when l_discount = 0.04 and l_tax = 0.04 then 'n/a' else rssi::varchar end as {ROOT}signal_strength,
               l_quantity::bigint::varchar as {ROOT}snr,
               l_quantity::bigint::varchar as {ROOT}airtime_util,
               l_linenumber::varchar as {ROOT}bw, l_linenumber::varchar as {ROOT}channel,
               l_partkey::varchar as {ROOT}tx_packets, l_orderkey::varchar as {ROOT}rx_packets,
               l_quantity::bigint::varchar as {ROOT}diff_tx_packets,
               l_linenumber::varchar as {ROOT}diff_rx_packets,
               sent::varchar as {ROOT}diff_bs, received::varchar as {ROOT}diff_br, '1' as {ROOT}connect_state
        from {{lines}}""",
    "parsed": f"""
        select rowkey, substr(rowkey, 6, length(rowkey) - 18) as serial_num,
               substr(rowkey, 1, 4) || '-' || substr(rowkey, 6, length(rowkey) - 18) as rk_row_sn,
               substr(rowkey, 1, 4) as rk_row, {ROOT}station_mac as station_mac, {ROOT}parent_id as parent_id,
               {lenient_long(ROOT + "signal_strength")} as sdcd_signal_strength,
               {lenient_long(f"left({ROOT}tx_link_rate, length({ROOT}tx_link_rate) - 4)")} as sdcd_tx_link_rate,
               {lenient_long(f"left({ROOT}link_rate, length({ROOT}link_rate) - 4)")} as sdcd_link_rate,
               left({ROOT}connect_type, 2) as sdcd_connect_type,
               {lenient_long(ROOT + "diff_bs")} as byte_send, {lenient_long(ROOT + "diff_br")} as byte_received
        from {{history}} where left({ROOT}connect_type, 2) in ('2.', '5G', '6G')""",
    "complete": """
        select * from {parsed} where sdcd_signal_strength is not null and sdcd_tx_link_rate is not null""",
    "metrics": f"""
        select rowkey, substr(rowkey, 6, length(rowkey) - 18) as serial_num,
               strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M:%S') as time,
               {lenient_long(f"replace({ROOT}tx_link_rate, 'Mbps', '')")} as sdcd_tx_link_rate,
               {lenient_long(f"left({ROOT}link_rate, length({ROOT}link_rate) - 4)")} as sdcd_link_rate,
               left({ROOT}connect_type, 2) as sdcd_connect_type, {ROOT}station_mac as station_mac,
               {ROOT}parent_id as parent_id, {lenient_long(ROOT + "airtime_util")} as airtime,
               {lenient_long(ROOT + "bw")} as bandwidth, {lenient_long(ROOT + "channel")} as channel_freq,
               {lenient_long(ROOT + "tx_packets")} as trans_packets,
               {lenient_long(ROOT + "rx_packets")} as recv_packets, {lenient_long(ROOT + "snr")} as snr,
               {lenient_long(ROOT + "signal_strength")} as sdcd_signal_strength,
               {lenient_long(ROOT + "diff_bs")} as byte_send, {lenient_long(ROOT + "diff_br")} as byte_received,
               {lenient_long(ROOT + "connect_state")} as connect_state,
               {lenient_long(ROOT + "diff_tx_packets")} as diff_tx_packets,
               {lenient_long(ROOT + "diff_rx_packets")} as diff_rx_packets
        from {{history}} where left({ROOT}connect_type, 2) in ('2.', '5G', '6G')""",
    "members": f"""
        select {HOME.format("l_suppkey")} as rowkey, 'P' || l_partkey as mac,
               case when p_type <> 'ECONOMY' then p_brand end as model,
               case when p_size % 2 = 0 then 'G' || l_suppkey end as parent_mac, 'fw' || p_size as fw
        from (select distinct l_suppkey, l_partkey from lineitem) join part on l_partkey = p_partkey
        union all
        select {HOME.format("l_suppkey")}, 'X' || l_partkey, 'spare', null, 'fw0'
        from (select distinct l_suppkey, l_partkey from lineitem) join part on l_partkey = p_partkey""",
    "groups": """
        select rowkey as dg_rowkey, mac as RouExt_mac, model as dg_model, max(parent_mac) as parent_mac,
               max(fw) as firmware
        from {members} group by rowkey, mac, model""",
    "mapping": f"""
        select s_name as mdn_5g, {SN.format("s_suppkey")} as serialnumber, s_nationkey::varchar as cust_id,
               case when s_acctbal > 0 then 'INSTALL COMPLETE' else 'PENDING' end as status
        from supplier
        union all
        select s_name || 'b', {SN.format("s_suppkey")}, s_nationkey::varchar,
               case when s_acctbal > 0 then 'INSTALL COMPLETE' else 'PENDING' end
        from supplier where s_acctbal > 9000""",
    "identity": """
        select mdn_5g as mdn, serialnumber as serial_num, cust_id from {mapping}
        where status = 'INSTALL COMPLETE'""",
    "everyone": "select mdn_5g as mdn, serialnumber as serial_num, cust_id from {mapping}",
    "devices": f"select distinct {KEYS} from {{tel}}",
    **_kpi_steps("", "tel"),
    **_kpi_steps("_p", "parsed"),
    **_kpi_steps("_q", "complete"),
    **_kpi_steps("_a", "parsed", KEYS + ", parent_id", 1),
    "parsed_two": """
        select * replace (case when substr(parent_id, 2)::bigint % 5 = 0 then 'P2' else 'P1' end as parent_id)
        from {parsed}""",
    **_kpi_steps("_ap", "parsed_two", KEYS + ", parent_id"),
    **_weights_b(""),
    **_weights_b("_p"),
    **_weights_c(""),
    **_weights_c("_q"),
    "devices_a": _devices_a("_a"),
    "devices_ap": _devices_a("_ap"),
    "rollup_b": _rollup("weights_b_p", "parents_p", ROLLUP_B),
    "devices_b": """
        select *, (100 - poor_rssi) * 0.4::double + (100 - poor_phyrate) * 0.6::double as device_score
        from {rollup_b}""",
    "rollup_c": _rollup("weights_c_q", "parents_q", ROLLUP_C),
    "devices_c": """
        select * replace (weights / nullif(sum(weights) over (partition by serial_num, mdn, cust_id), 0) as weights),
               (100 - poor_rssi) * 0.5::double + (100 - poor_phyrate) * 0.5::double as device_score
        from {rollup_c}""",
    "homes_b": _home("devices_b"),
    "homes_c": _home("devices_c"),
    "ev": "select event_id, user_id, event_type, ts::date as date from events",
    "device_days": """
        select ts::date as date, 'H' || user_id as serial_num, 'D' || user_id as mdn,
               'C' || user_id as cust_id, 'M' || event_id as station_mac, 5 + value * 6 as avg_phyrate,
               least(value / 2, 100.0::double) as poor_phyrate, k as poor_rssi,
               100 - least(value, 100.0::double) as device_score, k / 128 as weights,
               (event_id % 2)::double as stationarity, 2.0::double + k / 32 as volume,
               case when event_type in ('view', 'click') then -40 - k / 2 end as avg_sig_strength_cat1,
               case when event_type in ('click', 'signup', 'purchase') then -35 - k / 2 end as avg_sig_strength_cat2,
               case when event_type = 'error' then -30 - k / 2 end as avg_sig_strength_cat3,
               [event_type] as dg_model, [(event_type = 'purchase')::int] as Rou_Ext,
               'fw' || (event_id % 7) as firmware
        from (select * replace (floor(value * 64) / 64 as value),
                     json_extract_string(props, '$.k')::double as k from events)""",
    "home_days": f"""
        select date, serial_num, mdn, cust_id, dg_model[1] as dg_model_indiv,
               floor(avg(device_score) * 64) / 64 as home_score, count(*) as num_station,
               list(distinct dg_model) as dg_model, list(distinct Rou_Ext) as Rou_Ext
        from {{device_days}} group by date, serial_num, mdn, cust_id, dg_model[1]""",
    "cohort": f"""
        select b.serial_num from {_phase("2024-01-07", 3, 0)} b join {_phase("2024-01-10", 3, 1)} i
        using (serial_num) join {_phase("2024-01-13", 3, 1)} a using (serial_num)""",
    "counted": """
        select serial_num from
          (select serial_num, date, count(*) as n from {home_days}
           where date between date '2024-01-05' and date '2024-01-09' group by all)
        group by serial_num
        having count(*) filter (where date < date '2024-01-07' and n <= 2) = 2
           and count(*) filter (where date >= date '2024-01-07' and n >= 2) = 3""",
    "training_all": _before_after("2024-01-01", "2024-01-15", 7, None),
    "training": f"""
        select *, {rnd("after_home_score - before_home_score")} as score_increment from {{training_all}}""",
    "training_3_all": _before_after("2024-01-01", "2024-01-07", 3, None),
    "training_3": f"""
        select *, {rnd("after_home_score - before_home_score")} as score_increment from {{training_3_all}}""",
    "population": f"""
        select d.* rename (device_score as avg_device_score, lowest_n_scores as before_lowest_n_scores),
               before_home_score
        from ({_device_window(f"(select * from {{device_days}} where {_in_days('2024-01-15', 7)})", no_median=(),
                              volume=True)}) d
        join (select serial_num, {rnd("avg(home_score)")} as before_home_score from {{home_days}}
              where {_in_days("2024-01-15", 7)} group by 1) using (serial_num)""",
    "predicted": f"""
        select *, (score_increment > 0)::int as enhance_flag, coalesce({RULE}, false)::int as prediction
        from {{training}}""",
}


def _rounded(source: str, numbers: tuple[str, ...], rest: str) -> str:
    return f"select {rest}, {', '.join(f'{rnd(n)} as {n}' for n in numbers)} from {source}"


def _stored(source: str, features: tuple[str, ...]) -> str:
    """Device rows as written: sets as text, KPIs to 2 places, weights to 4."""
    two = {"avg_phyrate", "poor_phyrate", "poor_rssi", "device_score", "volume"}
    numbers = [f"{rnd(f, 2 if f in two else 4)} as {f}" for f in (*features, "device_score")]
    sets = [f"{texts(s)} as {s}" for s in SETS]
    return (
        f"select distinct serial_num, mdn, cust_id, rowkey, rk_row_sn, station_mac, {', '.join(numbers)},"
        f" {', '.join(sets)} from {source}"
    )


def _weights(source: str, weight: str, rate: str = "avg_phyrate", poor: str = "poor_phyrate") -> str:
    return (
        f"select {KEYS}, {rnd(rate)} as avg_phyrate, {rnd(poor)} as poor_phyrate, {rnd(weight)} as weights"
        f" from {source}"
    )


def _labels() -> str:
    parts = []
    for t in (0, 5, 10):
        parts.append(
            f"select {t}::int as threshold, (score_increment > {t})::int as enhance_flag, count(*) as count"
            " from training group by all"
        )
    return " union all ".join(parts)


def _bins() -> str:
    parts = []
    for name, edges in FEATURE_BINS.items():
        for i in range(len(edges) - 1):
            lo, hi = edges[i], edges[i + 1]
            positive = rnd("100 * avg((score_increment >= 0)::int)")
            parts.append(
                f"select '{name}' as feature, {i}::int as bin, '[{lo}, {hi})' as bin_range,"
                f" {positive} as score_increment_pos, count(*) as count"
                f" from training where {name} >= {lo} and {name} < {hi}"
            )
    return " union all ".join(parts)


def _buckets() -> str:
    arms = []
    for i in range(len(INCREMENT_EDGES) - 1):
        lo, hi = INCREMENT_EDGES[i], INCREMENT_EDGES[i + 1]
        last = i == len(INCREMENT_EDGES) - 2
        arms.append(
            f"when score_increment >= {lo} and score_increment {'<=' if last else '<'} {hi}"
            f" then '[{lo}, {hi}{']' if last else ')'}'"
        )
    share = rnd("count(*) * 100.0::double / sum(count(*)) over ()", 2)
    return f"""
        select range_label, count(*) as count, {share} as percentage_frequency
        from (select case {' '.join(arms)} end as range_label from training where {RULE}) where range_label is not null
        group by range_label"""


def _features() -> str:
    figures = []
    for m in FEATURE_METRICS:
        figures.append(f"{rnd(f'avg({m})', 2)} as {m}_avg")
        figures.append(f"{rnd(f'stddev_samp({m})', 2)} as {m}_stddev")
    return f"select rowkey, serial_num, station_mac, {', '.join(figures)} from metrics group by all"


def _metrics() -> str:
    parts = []
    for c in (0, 1):
        parts.append(f"""
            select {c}::int as label, hits::double / nullif(guessed, 0) as p, hits::double / nullif(support, 0) as r,
                   support, hit_any::double / nullif(n, 0) as a
            from (select count(*) filter (where enhance_flag = {c} and prediction = {c}) as hits,
                         count(*) filter (where prediction = {c}) as guessed,
                         count(*) filter (where enhance_flag = {c}) as support,
                         count(*) filter (where enhance_flag = prediction) as hit_any, count(*) as n
                  from predicted)""")
    return (
        f"select label, {rnd('p')} as precision, {rnd('r')} as recall, {rnd('2 * p * r / nullif(p + r, 0)')} as f1,"
        f" support, {rnd('a')} as accuracy from ({' union all '.join(parts)})"
    )


_DETAIL = f"""
    select strftime(l_shipdate, '%Y-%m-%d') as date, {SN.format("l_suppkey")} as serial_num,
           'D' || l_linenumber as mdn, l_linestatus as cust_id, l_discount * 100 as poor_rssi,
           l_tax * 100 as poor_phyrate, l_quantity as score, l_extendedprice / 100000 as weights,
           [l_returnflag, l_linestatus, l_returnflag] as dg_model
    from lineitem"""

_RESCORE = """
    select 'H' || user_id as serial_num, null::varchar as mdn, (user_id % 9)::varchar as cust_id,
           'M' || (k % 10) as station_mac, k::double as poor_rssi, k / 2 as poor_phyrate, k / 100 as weights,
           (100 - k)::double as device_score, [event_type] as dg_model,
           [(event_type = 'purchase')::int] as Rou_Ext
    from (select *, json_extract_string(props, '$.k')::int as k from events)"""

_EXACT = """
    select t.*, p.stationarity from tel t join (
      select {keys}, least(q[2] - 2 * (q[4] - q[2]), q[1]) as bound,
             case when abs(q[4] - q[3]) <= 5 then 1 else 0 end as stationarity
      from (select {keys}, quantile_cont(sdcd_signal_strength, [0.03, 0.1, 0.5, 0.9]) as q from tel group by {keys})
    ) p on {on} where sdcd_signal_strength >= bound""".format(keys=KEYS, on=on_keys("t", "p"))

def _chance(features: tuple[str, ...]) -> str:
    sums = " + ".join(["b0", *[f"b{k + 1} * {f}" for k, f in enumerate(features)]])
    return f"1 / (1 + exp(-({sums})))"


def _logistic(features: tuple[str, ...], steps: int = 25) -> str:
    """CTEs that end in `fitted`: coefficients b0, b1, ... of the penalised logistic loss, by Newton's method.

    Each step sums gradient and second derivatives over the training rows and solves the equations by
    elimination, one variable a step.
    """
    n, x = len(features) + 1, ["1", *features]
    out = [
        f"learned as materialized (select *, (score_increment > 0)::int as y from training where {_all_there(features)} and not {_is_test('serial_num')})",
        "weighed as materialized (select l.*, total / (2.0::double * c) as w, 1.0::double / total as penalty from learned l"
        " join (select y, count(*) as c from learned group by y) using (y) cross join (select count(*) as total from learned))",
        "newton_0 as materialized (select " + ", ".join(f"0.0::double as b{k}" for k in range(n)) + ")",
    ]
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    b = ", ".join(f"b{k}" for k in range(n))
    for s in range(steps):
        sums = [f"sum(w * (p - y) * {x[i]}) / sum(w) + {'0' if not i else f'any_value(penalty) * any_value(b{i})'} as g{i}" for i in range(n)]
        sums += [f"sum(w * p * (1 - p) * {x[i]} * {x[j]}) / sum(w) + {'any_value(penalty)' if i == j and i else '0'} as h{i}{j}" for i, j in cells]
        kept = ", ".join(f"any_value(b{k}) as b{k}" for k in range(n))
        out.append(f"sums_{s} as materialized (select {kept}, {', '.join(sums)} from (select *, {_chance(features)} as p from weighed cross join newton_{s}))")
        before = f"sums_{s}"
        for c in range(n - 1):  # the upper half is enough, for the equations are symmetric
            new = [f"g{i} - h{c}{i} / h{c}{c} * g{c} as g{i}" if i > c else f"g{i}" for i in range(n)]
            new += [f"h{i}{j} - h{c}{i} / h{c}{c} * h{c}{j} as h{i}{j}" if i > c else f"h{i}{j}" for i, j in cells]
            out.append(f"eliminated_{s}_{c} as materialized (select {b}, {', '.join(new)} from {before})")
            before = f"eliminated_{s}_{c}"
        for i in reversed(range(n)):
            rest = "".join(f" - h{i}{j} * d{j}" for j in range(i + 1, n))
            out.append(f"solved_{s}_{i} as materialized (select *, (g{i}{rest}) / h{i}{i} as d{i} from {before})")
            before = f"solved_{s}_{i}"
        out.append(f"newton_{s + 1} as materialized (select {', '.join(f'b{k} - d{k} as b{k}' for k in range(n))} from {before})")
    return ",\n" + ",\n".join([*out, f"fitted as (select {b} from newton_{steps})"])


ORACLE: dict[str, str] = {
    "telemetry_parse": ctes("parsed") + "select * from parsed",
    "telemetry_complete": ctes("complete") + "select * from complete",
    "flatten_struct": ctes("history") + "select * from history",
    "flatten_arrays": f"""
        select mark as head_b_marks, o_orderkey as head_b_id_b_key, kind as amounts_b_kind,
               {rnd("case kind when 'total' then o_totalprice else o_totalprice / 2 end")} as amounts_b_amount
        from orders, unnest([o_orderstatus, o_orderpriority]) as m(mark), unnest(['total', 'half']) as k(kind)
        where o_orderstatus <> 'P'""",
    "explode_groups": ctes("groups") + "select * from groups",
    "explode_nested": ctes("home_days")
    + "select date::varchar as date, serial_num, dg_model_indiv, unnest(flatten(dg_model)) as dg_model from home_days",
    "row_keys": ctes("tel")
    + """
        select distinct rowkey, substr(rowkey, 1, 4) as rk_row, substr(rowkey, 6, length(rowkey) - 18) as serial_num,
               substr(rowkey, 6, length(rowkey) - 22) as rk_sn, length(rowkey)::int as rowkey_length,
               length(substr(rowkey, 6, length(rowkey) - 22))::int as rk_sn_length,
               substr(rowkey, 1, 4) || '-' || substr(rowkey, 6, length(rowkey) - 18) as rk_row_sn
        from tel""",
    "cast_rename_map": ctes("metrics") + "select * from metrics",
    "cast_all_but": f"""
        select p_partkey::double as p_partkey, p_name, try_cast(p_brand as double) as p_brand, p_type,
               p_size::double as p_size, {rnd("p_retailprice")} as p_retailprice from part""",
    "round_columns": f"""
        select l_orderkey, l_linenumber, l_returnflag, {rnd("l_extendedprice * (1 - l_discount)", 2)} as revenue,
               {rnd("l_extendedprice / l_quantity", 2)} as unit_price from lineitem""",
    "epoch_ms_to_ts": "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as time from events",
    "poor_rssi": ctes("rssi")
    + _rounded(
        "rssi",
        ("poor_rssi", "avg_sig_strength_cat1", "avg_sig_strength_cat2", "avg_sig_strength_cat3", "volume"),
        f"{KEYS}, total_count, byte_send, byte_received",
    ),
    "poor_phyrate": ctes("phy") + _rounded("phy", ("avg_phyrate", "poor_phyrate"), f"{KEYS}, total_count"),
    "stationarity": ctes("stationary") + "select * from stationary",
    "stationarity_lenient": ctes("pct")
    + f"select {KEYS}, case when p90 - p50 <= 5 then 1 else 0 end as stationarity from pct",
    "stationarity_exact": ctes("tel")
    + f"select {KEYS}, parent_id, sdcd_signal_strength, stationarity from ({_EXACT})",
    "weights_a": ctes("phy")
    + _weights(
        "(select *, case when avg_phyrate >= 20.718 then 1.0 else avg_phyrate / 20.718 end::double as label from phy)",
        "label * 100 / sum(label) over ()",
    ),
    "weights_a_per_home": ctes("phy")
    + _weights(
        "(select *, case when avg_phyrate >= 20.718 then 1.0 else avg_phyrate / 20.718 end::double as label from phy)",
        "label / sum(label) over (partition by serial_num)",
    ),
    "weights_b": ctes("weights_b") + _weights("weights_b", "weights"),
    "weights_c": ctes("weights_c") + _weights("weights_c", "weights"),
    "volume_share": ctes("share_c")
    + f"select {KEYS}, byte_send, byte_received, {rnd('volume')} as volume, {rnd('w')} as weights from share_c",
    "identity_join": ctes("devices", "identity")
    + "select d.*, mdn, cust_id from devices d left join identity i using (serial_num)",
    "identity_inner": ctes("devices", "everyone")
    + "select d.*, mdn, cust_id from devices d join everyone i using (serial_num)",
    "identity_left": ctes("devices", "everyone")
    + "select distinct d.*, mdn, cust_id from devices d left join everyone i using (serial_num)",
    "topology_join": ctes("parents", "groups")
    + f"""
        select {KEYS}, parent_id, RouExt_mac, dg_model, parent_mac, firmware,
               case when parent_mac is not null then 1 else 0 end as Rou_Ext
        from parents left join groups on dg_rowkey = rk_row_sn and RouExt_mac = parent_id""",
    "device_score_a": ctes("devices_a")
    + _rounded(
        "devices_a where Rou_Ext = 1",
        ("avg_phyrate", "poor_phyrate", "weights", "poor_rssi", "device_score"),
        f"mdn, cust_id, {KEYS}, parent_id, RouExt_mac, dg_model, parent_mac, firmware, Rou_Ext",
    ),
    "device_score_b": ctes("devices_b") + _stored("devices_b", ROLLUP_B),
    "device_score_c": ctes("devices_c") + _stored("devices_c", ROLLUP_C),
    "home_score_a": ctes("devices_a")
    + f"""
        select serial_num, mdn, cust_id, Rou_Ext, {rnd(weighted("poor_rssi"))} as poor_rssi,
               {rnd(weighted("poor_phyrate"))} as poor_phyrate,
               {rnd(weighted("device_score"))} as home_score, max(firmware) as firmware
        from devices_a where Rou_Ext = 1 group by serial_num, mdn, cust_id, Rou_Ext""",
    "home_score_b": ctes("homes_b") + _per_model("homes_b"),
    "home_score_c": ctes("homes_c") + _per_model("homes_c"),
    "rescore_homes": f"""
        with stored as ({_RESCORE}),
        once as (select serial_num, mdn, cust_id, station_mac, poor_rssi, poor_phyrate, weights, device_score,
                        list(distinct dg_model) as dg_model, list(distinct Rou_Ext) as Rou_Ext
                 from stored group by all),
        homes as ({_home("once").replace("{once}", "once")})
        select serial_num, mdn, cust_id, poor_rssi, poor_phyrate, home_score,
               {texts("flatten(flatten(dg_model))")} as dg_model, {texts("flatten(flatten(Rou_Ext))")} as Rou_Ext,
               unnest(list_distinct(flatten(flatten(dg_model)))) as dg_model_indiv
        from homes""",
    "home_from_detail": ctes("everyone")
    + f"""
        , detail as ({_DETAIL}),
        homes as (select serial_num, mdn, cust_id, {rnd(weighted("poor_rssi"))} as poor_rssi,
                         {rnd(weighted("poor_phyrate"))} as poor_phyrate,
                         {rnd(weighted("score"))} as home_score, max(dg_model) as dg_model, max(date) as date
                  from detail group by serial_num, mdn, cust_id),
        per_model as (select distinct * from (select date, serial_num, poor_rssi, poor_phyrate, home_score,
                         {texts("dg_model")} as dg_model, unnest(dg_model) as dg_model_indiv from homes))
        select distinct p.*, e.mdn, e.cust_id from per_model p left join everyone e using (serial_num)""",
    "latest_snapshot": ctes("ev")
    + """
        select * replace (date::varchar as date) from ev
        where date = (select max(date) from ev where date between date '2024-01-28' and date '2024-02-01')""",
    "snapshot_fallback": ctes("ev") + "select * replace (date::varchar as date) from ev where date = date '2024-01-05'",
    "read_days_skip": ctes("ev")
    + f"select * replace (date::varchar as date) from ev where {_in_days('2024-01-28', 7)}",
    "read_days_strict": ctes("ev")
    + f"select distinct user_id, event_type, date::varchar as date from ev where {_in_days('2024-01-10', 4)}",
    "missing_days": ctes("ev")
    + """
        select d::date::varchar as date from generate_series(date '2024-01-25', date '2024-02-05', interval 1 day) t(d)
        where d::date not in (select date from ev)""",
    "model_snapshot": ctes("tel", "groups")
    + """
        select * from tel where serial_num in
          (select substr(dg_rowkey, 6) from groups where dg_model || '/' || firmware = 'Brand#3/fw7')""",
    "device_features": ctes("metrics") + _features(),
    "flag_window": ctes("device_days")
    + f"""
        select serial_num, max(flag) as Rou_Ext from device_days, unnest(Rou_Ext) as u(flag)
        where {_in_days("2024-01-10", 3)} group by serial_num""",
    "cohort_flags": ctes("cohort") + "select serial_num from cohort",
    "cohort_flags_install": ctes("device_days")
    + _fill(f"""
        select b.serial_num from {_phase("2024-01-06", 4, 0, 1)} b join {_phase("2024-01-10", 4, 1, 1)} i
        using (serial_num) join {_phase("2024-01-10", 4, 1, 1)} a using (serial_num)"""),
    "cohort_counts": ctes("counted") + "select serial_num from counted",
    "homes_with_one_model": ctes("home_days")
    + """
        select serial_num, date::varchar as date, count(*) as count from home_days
        group by serial_num, date having count(*) = 1""",
    "lowest_n": ctes("device_days")
    + f"""
        select serial_num, {rnd("list_avg(list_sort(list(device_score))[1:5])")} as lowest_n_scores
        from device_days group by serial_num""",
    "total_volume": ctes("device_days")
    + f"select serial_num, {rnd('sum(exp(volume))')} as total_volume from device_days group by serial_num",
    "agg_device_window": ctes("device_days")
    + _device_window(f"(select * from device_days where {_in_days('2024-01-01', 7)})", volume=True),
    "agg_home_window": ctes("home_days")
    + f"""
        select serial_num, dg_model_indiv, {rnd("avg(home_score)")} as home_score,
               {rnd("avg(num_station)")} as num_station
        from home_days where {_in_days("2024-01-01", 7)} and dg_model_indiv in ('click', 'purchase', 'view')
        group by serial_num, dg_model_indiv""",
    "training_set": ctes("cohort", "device_days", "home_days")
    + _fill(_before_after("2024-01-07", "2024-01-13", 3, "cohort")),
    "install_list": ctes("counted", "device_days", "home_days")
    + _fill(f"""
        select f.*, b.dg_model_indiv, b.before_home_score, b.num_station, a.after_home_score,
               '2024-01-07' as date_string
        from ({_device_window(
            f"(select * from device_days where {_in_days('2024-01-05', 2)} and serial_num in (select * from counted))"
        )}) f
        join (select serial_num, dg_model_indiv, {rnd("avg(home_score)")} as before_home_score,
                     {rnd("avg(num_station)")} as num_station
              from home_days where {_in_days("2024-01-05", 2)} and dg_model_indiv in ('click', 'purchase', 'view')
              group by 1, 2) b using (serial_num)
        join (select serial_num, {rnd("avg(home_score)")} as after_home_score from home_days
              where {_in_days("2024-01-08", 2)} and dg_model_indiv in ('click', 'purchase', 'view')
              group by 1) a using (serial_num)"""),
    "router_population": ctes("device_days", "home_days")
    + f"""
        select d.* rename (device_score as avg_device_score, lowest_n_scores as before_lowest_n_scores),
               before_home_score
        from ({_device_window(f"(select * from device_days where {_in_days('2024-01-15', 7)})", no_median=(),
                              volume=True)}) d
        join (select serial_num, {rnd("avg(home_score)")} as before_home_score from home_days
              where {_in_days("2024-01-15", 7)} and dg_model_indiv in ('click', 'purchase', 'view')
              group by 1) using (serial_num)""",
    "model_family": ctes("home_days")
    + f"""
        select date::varchar as date, serial_num,
               case when dg_model_indiv = 'signup' then 'others' else dg_model_indiv end as dg_model_indiv,
               {rnd("home_score")} as home_score
        from home_days where dg_model_indiv in ('click', 'error', 'view', 'signup')""",
    "report_month_model": f"""
        select o_orderpriority as dg_model_indiv, month(o_orderdate)::int as month,
               {rnd("avg(o_totalprice / 5000)", 2)} as average_home_score, count(*) as count
        from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW')
        group by 1, 2 order by month, dg_model_indiv""",
    "report_day_model": ctes("home_days")
    + f"""
        select model as dg_model, date::varchar as date, {rnd("avg(home_score)", 2)} as home_score, count(*) as count
        from (select distinct h.* exclude (dg_model), m.model from home_days h, unnest(flatten(dg_model)) as m(model))
        where model in ('click', 'purchase', 'view') group by model, date order by dg_model, date""",
    "report_day_model_listed": ctes("home_days")
    + f"""
        select model as dg_model, date::varchar as date, {rnd("avg(home_score)", 2)} as home_score, count(*) as count
        from (select distinct h.* exclude (dg_model), m.model from home_days h, unnest(flatten(dg_model)) as m(model))
        where model in ('click', 'purchase', 'view') group by model, date
        order by list_position(['view', 'purchase', 'click'], dg_model), date""",
    "report_subscribers": ctes("home_days")
    + f"""
        select serial_num, {rnd("home_score")} as home_score, dg_model_indiv, mdn, cust_id, date::varchar as date
        from home_days where {_in_days("2024-01-01", 20)} and mdn in ('D1', 'D7', 'D33')""",
    "report_model_extract": ctes("home_days")
    + f"""
        select date::varchar as date, serial_num, mdn, cust_id, model as dg_model_indiv,
               {rnd("home_score")} as home_score, num_station
        from home_days, unnest(flatten(dg_model)) as m(model)
        where {_in_days("2024-01-24", 7)} and mdn in ('D1', 'D7', 'D33') and model in ('click', 'purchase', 'view')""",
    "increment_distribution": ctes("training") + _buckets(),
    "feature_bins": ctes("training") + _bins(),
    "rule_classifier": ctes("training")
    + f"""
        select count(*) as homes, count(*) filter (where {RULE}) as predicted,
               {rnd(f"100.0::double * count(*) filter (where {RULE}) / count(*)", 2)} as predicted_pct,
               {rnd(f"100.0::double * count(*) filter (where {RULE} and score_increment > 0)"
                    f" / nullif(count(*) filter (where {RULE}), 0)", 2)} as improved_pct
        from training""",
    "rule_selected": ctes("training")
    + f"""
        select serial_num, avg_phyrate, poor_phyrate, poor_rssi, count, score_increment from training
        where {RULE}""",
    "histogram": ctes("training")
    + f"""
        select b::int as bin, -20 + (b - 1) * 3.5::double as bin_low, -20 + b * 3.5::double as bin_high,
               (select count(*) from training
                where {RULE} and score_increment between -20 and 50
                  and least(floor((score_increment + 20) / 3.5::double)::int + 1, 20) = b) as count
        from range(1, 21) t(b)""",
    "label_sweep": ctes("training") + _labels(),
    "label_counts": ctes("training")
    + "select (score_increment > 5)::int as enhance_flag, count(*) as count from training group by 1",
    "hash_split": ctes("training_all") + f"select serial_num, {_is_test('serial_num')} as is_test from training_all",
    "class_weights": ctes("training")
    + f"""
        select enhance_flag, count(*) as count,
               {rnd("sum(count(*)) over () / (2.0::double * count(*))")} as class_weight
        from (select (score_increment > 0)::int as enhance_flag from training where not {_is_test('serial_num')})
        group by enhance_flag""",
    "confusion_matrix": ctes("predicted")
    + "select enhance_flag as label, prediction, count(*) as count from predicted group by 1, 2",
    "confusion_metrics": ctes("predicted") + _metrics(),
    "impute_mean": ctes("device_days")
    + f"""
        select date::varchar as date, station_mac,
               {rnd("coalesce(avg_sig_strength_cat1, avg(avg_sig_strength_cat1) over ())")} as avg_sig_strength_cat1,
               {rnd("coalesce(avg_sig_strength_cat2, avg(avg_sig_strength_cat2) over ())")} as avg_sig_strength_cat2
        from device_days""",
    "population_rows": ctes("population")
    + f"""
        select serial_num, {", ".join(c for c in MODEL_FEATURES if not c.startswith("avg_sig"))},
               coalesce(avg_sig_strength_cat1, -60) as avg_sig_strength_cat1,
               coalesce(avg_sig_strength_cat2, -65) as avg_sig_strength_cat2
        from population where before_home_score < 100 and volume is not null""",
    "json_roundtrip": f"""
        select o_orderkey, o_custkey as o_b_o_custkey, o_orderstatus as o_b_o_orderstatus,
               {rnd("o_totalprice")} as o_b_o_totalprice, o_orderdate::date::varchar as o_b_o_orderdate,
               o_orderpriority as o_b_o_orderpriority from orders""",
    "csv_roundtrip": f"""
        select p_partkey::varchar as p_partkey, p_name, p_brand, p_type, p_size::varchar as p_size,
               {rnd("p_retailprice")} as p_retailprice from part""",
    "read_day_files": ctes("ev")
    + f"""
        select date::varchar as date, event_type, count(*) as count from ev
        where {_in_days("2024-01-02", 4)} group by date, event_type""",
    "overwrite_empty_day": ctes("ev")
    + """
        select date::varchar as date, count(*) as count from ev
        where date not in (date '2024-01-03', date '2024-01-05') group by date""",
    "overwrite_files": ctes("ev") + "select date::varchar as date, count(*) as count from ev group by date",
    "window_dataset": ctes("training")
    + """
        select serial_num, score_increment, '2024-01-01' as before_date, '2024-01-08' as install_date,
               '2024-01-15' as after_date, 7::int as window_days from training""",
    "device_score_a_published": ctes("devices_ap")
    + _rounded(
        "devices_ap",
        ("avg_phyrate", "poor_phyrate", "weights", "poor_rssi", "device_score"),
        f"mdn, cust_id, {KEYS}, parent_id, RouExt_mac, dg_model, parent_mac, firmware, Rou_Ext",
    ),
    "cohort_counts_published": f"""
        select distinct {SN.format("user_id")} as serial_num from events where user_id % 3 = 0""",
    "rule_classifier_published": ctes("training")
    + f"""
        select count(*) as homes, count(*) filter (where {RULE_200}) as predicted,
               {rnd(f"100.0::double * count(*) filter (where {RULE_200}) / count(*)", 2)} as predicted_pct,
               {rnd(f"100.0::double * count(*) filter (where {RULE_200} and score_increment > 0)"
                    f" / nullif(count(*) filter (where {RULE_200}), 0)", 2)} as improved_pct
        from training""",
    "rf_scores": ctes("population")
    + f"""
        select serial_num, case when {_all_there(f for f in MODEL_FEATURES if not f.startswith("avg_sig"))} then true end
                 as scored, true as same_by_table
        from population where before_home_score < 100 and volume is not null""",
    "rf_metrics": ctes("training")
    + f"""
        select label, count(*) filter (where flag = label) as support, count(*) > 0 as measured,
               true as same_by_table, true as learned
        from (values (0), (1)) l(label), (select (score_increment > 0)::int as flag from training
              where before_home_score > 50 and {_is_test("serial_num")}
                and {_all_there(f for f in MODEL_FEATURES if not f.startswith("avg_sig"))})
        group by label""",
    "lr_scores": ctes("training") + _logistic(SWEEP_FEATURES)
    + f"""
        select serial_num, (score_increment > 0)::int as enhance_flag, {_is_test("serial_num")} as is_test,
               case when {_all_there(SWEEP_FEATURES)} then {rnd(_chance(SWEEP_FEATURES))} end as extender_score, true as at_optimum
        from training cross join fitted""",
    "forest_table_scores": ctes("population")
    + f"""
        select serial_num, {rnd("""(case when avg_phyrate > 310.5 then 0.25 when poor_rssi <= 24 then 0.75 else 24 / 27.0::double end
               + case when count <= 14 then 0.25 when volume <= 2.75 then 0.2 else 0.5 end + 0.45) / 3""")} as extender_score
        from population""",
    "rf_population_share": ctes("population")
    + f"""
        select threshold, count(*) as homes, true as same_by_table from population, (values (0), (5), (10)) t(threshold)
        where {_all_there(SWEEP_FEATURES)} group by threshold""",
    "window_sweep": ctes("training", "training_3")
    + f"""
        select window_days, threshold, label, count(*) filter (where (score_increment > threshold)::int = label) as support, true as same_by_table
        from (select 7::int as window_days, * from training union all by name
              select 3::int as window_days, * from training_3),
             (values (0), (5)) t(threshold), (values (0), (1)) l(label)
        where {_is_test("serial_num")} and {_all_there(SWEEP_FEATURES)} group by window_days, threshold, label""",
    "parquet_overwrite_day": ctes("ev")
    + """
        select date::varchar as date, event_type, count(*) as count from ev
        where date not between date '2024-01-03' and date '2024-01-04' or event_type = 'click'
        group by date, event_type""",
    "read_day_folders": ctes("ev")
    + f"""
        select date::varchar as date, event_type, count(*) as count from ev
        where {_in_days("2024-01-26", 10)} group by date, event_type""",
    "report_csv": ctes("home_days")
    + f"""
        select serial_num, {rnd("home_score")} as home_score, dg_model_indiv, mdn, cust_id, date::varchar as date
        from home_days where {_in_days("2024-01-01", 20)} and mdn in ('D1', 'D7', 'D33')""",
    "cohort_counts_starts": ctes("home_days")
    + f"""
        select serial_num, start::varchar as start
        from (select serial_num, date, count(*) as n from home_days group by all), {_starts("2024-01-05")}
        where date between start - 2 and start + 2 group by serial_num, start
        having count(*) filter (where date < start and n <= 2) = 2 and count(*) filter (where date >= start and n >= 2) = 3""",
    "cohort_counts_starts_published": f"""
        with u as (select distinct user_id from events),
        d as (select user_id, i as day, 1 + (i >= 8 + user_id % 7)::int as n from u, range(30) t(i)
              where not (user_id % 5 = 4 and i = 16))
        select {SN.format("user_id")} as serial_num, start::varchar as start
        from (select user_id, date '2024-03-01' + day::int as date, n from d), {_starts("2024-03-08")}
        where date between start - 7 and start + 7 group by user_id, start
        having count(*) filter (where date < start and n = 1) = 7 and count(*) filter (where date >= start and n = 2) = 8""",
    "cohort_flags_installs": ctes("device_days")
    + f"""
        select serial_num, start::varchar as start
        from (select serial_num, date, max(flag) as flag from device_days, unnest(Rou_Ext) as u(flag) group by all), {_starts("2024-01-05")}
        group by serial_num, start
        having max(flag) filter (where date between start - 3 and start - 1) = 0
           and max(flag) filter (where date between start and start + 2) = 1
           and max(flag) filter (where date between start + 3 and start + 5) = 1""",
    "device_day_states": ctes("device_days")
    + f"""
        select serial_num, date::varchar as date, count(*) as rows,
               {", ".join(f"{rnd(f'sum({f})')} as sum_{f}, count({f}) as n_{f}" for f in ("avg_phyrate", "volume", "avg_sig_strength_cat3"))},
               {rnd("sum(exp(volume))")} as total_volume,
               array_to_string(list_sort(list(device_score))[1:5], ',') as lowest
        from device_days group by serial_num, date""",
    "exact_medians": """
        select o_orderpriority, 'o_totalprice' as name, quantile_disc(o_totalprice, 0.5)::double as median from orders group by 1
        union all
        select o_orderpriority, 'minus_customer', quantile_disc(o_custkey * -1.0::double, 0.5) from orders group by 1""",
    "published_days": ctes("ev")
    + """
        select date::varchar as date, event_type, count(*) as count, case when date > date '2024-01-02' then count(*) end as n
        from ev where date between date '2024-01-02' and date '2024-01-04' and (date <> date '2024-01-03' or event_type = 'click')
        group by date, event_type""",
    "snapshots_as_of": ctes("device_days")
    + f"""
        , s as ({_SNAPSHOTS}), n as (select start as as_of, max(date) as date from s, {_starts("2024-01-05", 9)}
              where date between start - 4 and start - 1 group by start)
        select as_of::varchar as as_of, date::varchar as date, count(*) as homes from n join s using (date) group by all""",
    "identity_as_of": ctes("device_days", "home_days")
    + f"""
        , s as ({_SNAPSHOTS}), n as (select start as as_of, max(date) as date from s, {_starts("2024-01-05", 9)}
              where date between start - 4 and start - 1 group by start),
        i as (select n.as_of, serial_num, serial_num || '@' || s.date as mdn, cust_id from n join s using (date)
              where substr(serial_num, 2)::int % 5 > 0)
        select h.date::varchar as date, h.serial_num, h.dg_model_indiv, i.mdn, i.cust_id
        from home_days h left join i on i.as_of = h.date and i.serial_num = h.serial_num where {_in_days("2024-01-05", 9)}""",
    "topology_as_of": ctes("ev")
    + f"""
        , s as (select *, 'H' || user_id as home from ev where day(date) in (2, 3, 6, 11, 14)),
        n as (select start as as_of, max(date) as date from s, {_starts("2024-01-05", 9)}
              where date between start - 4 and start - 1 group by start),
        g as (select as_of, home, event_type, 'm' || day(date) as dg_model, max(case when event_id % 2 = 0 then 'G' end) as parent_mac,
                     max('fw' || event_id % 9) as firmware from n join s using (date) group by all),
        r as (select distinct date, 'H' || user_id as home, event_type from ev where {_in_days("2024-01-05", 9)})
        select r.date::varchar as date, r.home as rk_row_sn, r.event_type as parent_id, g.event_type as RouExt_mac, g.dg_model,
               g.parent_mac, g.firmware, (g.parent_mac is not null)::int as Rou_Ext
        from r left join g on g.as_of = r.date and g.home = r.home and g.event_type = r.event_type""",
    "bad_json_lines": f"""
        with e as ({_ODD})
        select day, 'good' as reason, count(*) as count from e where odd is null group by day union all
        select null, odd, count(*) from e where odd is not null group by odd""",
    "bad_csv_lines": f"""
        select coalesce(odd, 'good') as reason, count(*) as count from ({_ODD}) group by 1""",
}

ORACLE["training_set_bucketed"] = ORACLE["training_set"]
# The same rows from daily states.
ORACLE |= {f"{name}_states": ORACLE[name] for name in ("agg_device_window", "agg_home_window", "router_population")}
