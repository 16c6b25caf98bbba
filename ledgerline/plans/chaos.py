"""SQL of what a replay under scheduled faults must show, said without a replay.

Every feed has the schedule of one seed. A replay by the policy `as_of` always shows the true book at its last sequence
number, so it is enough to know which rows of the faulted log publish a view, and of which sequence number.
"""

from __future__ import annotations

from ..operators.inject import JITTER, PERIOD, PLAN

#: The constants of SplitMix64, and 2^64.
GAMMA, FACTORS, WRAP = 11400714819323198485, (13787848793156543929, 10723151780598845931), 18446744073709551616


def _spread(name: str, source: str, keep: str, x: str) -> str:
    """CTEs that end in `name`: `keep` and z, the output for x (a UHUGEINT below 2^64)."""
    m = f"{WRAP}::uhugeint"
    return f"""{name}0 as (select {keep}, ({x} + {GAMMA}::uhugeint) % {m} z from {source}),
{name}1 as (select {keep}, xor(z, z // {2**30}::uhugeint) * {FACTORS[0]}::uhugeint % {m} z from {name}0),
{name}2 as (select {keep}, xor(z, z // {2**27}::uhugeint) * {FACTORS[1]}::uhugeint % {m} z from {name}1),
{name} as (select {keep}, xor(z, z // {2**31}::uhugeint) z from {name}2)"""


_KINDS = ", ".join(f"({i}, '{kind}', {first})" for i, (kind, first) in enumerate(PLAN.items(), start=1))

#: sc: the fault of each step of a feed, by seed 1. fa: the rows of ev with their fault, and that of the row before.
SCHEDULE = f"""sd as (select 0 o, 1::uhugeint x), {_spread("sp", "sd", "o", "x")},
pe as (select p, sp.z s from sp, (select unnest(range(0, (select max(arrival) from ev) // {PERIOD} + 1)) p)), {_spread("pz", "pe", "p", "(s + p::uhugeint)")},
kd(k, fault, first) as (values {_KINDS}), pk as (select p, k, fault, first, z s from pz, kd), {_spread("kz", "pk", "p, fault, first", "(s + k::uhugeint)")},
sc as (select p * {PERIOD} + first + (z % {JITTER}::uhugeint)::bigint step, fault from kz),
fa as (select ev.*, fault, lag(fault) over (partition by symbol order by arrival) before, max(arrival) over (partition by symbol) n from ev left join sc on sc.step = ev.arrival - 1)"""

#: pv: the published views (gen, arrival in the faulted log, last sequence number, mark of a gap or cross); bs: the best
#: prices and sizes of the true book after each of these sequence numbers.
VIEWS = f"""{SCHEDULE},
lo as (select venue, symbol, arrival a, -1 b, arrival - 1 seq, case when fault = 'cross' then 'cross' end mark from fa where fault in ('disconnect', 'cross')
union all select venue, symbol, arrival, 0, null, null from fa
union all select venue, symbol, arrival, 1, arrival, case when before in ('gap', 'reorder') then 'gap' end from fa where coalesce(before, '') != 'coalesce' and coalesce(fault, '') not in ('gap', 'reorder', 'coalesce')
union all select venue, symbol, arrival, 2, null, null from fa where fault = 'duplicate'
union all select venue, symbol, arrival + 1, 3, case when arrival = n then n end, null from fa where fault = 'reorder'
union all select venue, symbol, least(arrival + 1, n), 1, least(arrival + 1, n), null from fa where fault = 'coalesce'),
nb as (select *, row_number() over (partition by symbol order by a, b) arrival from lo),
pv as (select venue, symbol, arrival, seq, mark, row_number() over (partition by symbol order by arrival) gen from nb where seq is not null),
wr as (select symbol, side, price, size, arrival w, lead(arrival) over (partition by symbol, side, price order by arrival) nx from ev),
bs as (select pv.symbol, pv.seq, max(case when side = 'bid' then price end) bid, arg_max(size, case when side = 'bid' then price end) bid_size, min(case when side = 'ask' then price end) ask, arg_min(size, case when side = 'ask' then price end) ask_size
 from (select distinct symbol, seq from pv) pv join wr on wr.symbol = pv.symbol and wr.w <= pv.seq and coalesce(wr.nx, 9223372036854775807) > pv.seq where size > 0 group by all)"""
