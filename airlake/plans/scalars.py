"""Scalar column functions over the city-hour, station and fire views."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake import fixtures as fx
from airlake.functions import aqi, geo, physics, timing
from airlake.functions.numeric import clip
from airlake.plans.registry import query


def _r(c, n=6):
    return F.round(c, n)


def _rt(c, n=6):
    """Round for comparison; the hair above one keeps exact decimal ties from depending on the engine."""
    return F.round(c * F.lit(1.000000001), n)


_HAV = """2*{r}*asin(sqrt(least(power(sin(radians({b}-{a})/2),2)
    + cos(radians({a}))*cos(radians({b}))*power(sin(radians({d}-{c})/2),2), 1)))"""


def hav_sql(a: str, c: str, b: str, d: str, r: float = 6371.0) -> str:
    return _HAV.format(a=a, b=b, c=c, d=d, r=r)


def bearing_sql(a: str, c: str, b: str, d: str) -> str:
    return (f"((degrees(atan2(sin(radians({d}-{c}))*cos(radians({b})), "
            f"cos(radians({a}))*sin(radians({b})) - sin(radians({a}))*cos(radians({b}))*cos(radians({d}-{c})))) + 360 + 360) % 360)")


@query("haversine_km", "fire", f"""select ok, ln, round({hav_sql('lat', 'lon', '28.6139', '77.2090')}, 4) as dist_km,
    round({hav_sql('lat', 'lon', '28.6139', '77.2090', 6371.0088)}, 4) as dist_graph_km from fire""")
def haversine_km(spark, sf):
    la, lo = (F.lit(x) for x in geo.CITY_CENTRE)
    f = fx.fire(spark, sf)
    return f.select("ok", "ln", _r(geo.haversine_km(F.col("lat"), F.col("lon"), la, lo), 4).alias("dist_km"),
                    _r(geo.haversine_km(F.col("lat"), F.col("lon"), la, lo, 6371.0088), 4).alias("dist_graph_km"))


@query("bearing_deg", "fire", f"""select ok, ln, round({bearing_sql('lat', 'lon', '28.6139', '77.2090')}, 4) as to_city,
    round({bearing_sql('28.6139', '77.2090', 'lat', 'lon')}, 4) as from_city from fire""")
def bearing_deg(spark, sf):
    la, lo = (F.lit(x) for x in geo.CITY_CENTRE)
    f = fx.fire(spark, sf)
    return f.select("ok", "ln", _r(geo.bearing_deg(F.col("lat"), F.col("lon"), la, lo), 4).alias("to_city"),
                    _r(geo.bearing_deg(la, lo, F.col("lat"), F.col("lon")), 4).alias("from_city"))


@query("upwind_flag", "fire", f"""with b as (select ok, ln, acq_h, {bearing_sql('lat', 'lon', '28.6139', '77.2090')} as br from fire),
    w as (select *, case when acq_h%5=0 then null else (acq_h*7)%360 + 0.25e0 end as wd from b)
    select ok, ln, case when wd is null then br between 270 and 360
        else abs(((br - wd + 180 + 720) % 360) - 180) <= 90 end as upwind,
        br between 270 and 360 as sector from w""")
def upwind_flag(spark, sf):
    la, lo = (F.lit(x) for x in geo.CITY_CENTRE)
    wd = F.when(F.col("acq_h") % 5 != 0, (F.col("acq_h") * 7) % 360 + F.lit(0.25))
    b = geo.bearing_deg(F.col("lat"), F.col("lon"), la, lo)
    return fx.fire(spark, sf).select("ok", "ln", geo.upwind(b, wd).alias("upwind"), geo.upwind(b).alias("sector"))


@query("cyclic_time", "ch", """select city, t, round(sin(2*pi()*hour(t)/24),6) as hour_sin, round(cos(2*pi()*hour(t)/24),6) as hour_cos,
    round(sin(2*pi()*dayofyear(t)/365.25e0),6) as doy_sin, round(cos(2*pi()*dayofyear(t)/365.25e0),6) as doy_cos from ch""")
def cyclic_time(spark, sf):
    from airlake.operators.features import cyclic

    return fx.ch(spark, sf).select("city", "t", *[_r(c).alias(n) for n, c in cyclic(F.col("t")).items()])


@query("inversion_strength", "chx", """select city, t, round(1/(1+exp(-((rh/20-0.5e0)/0.3e0))) * 1/(1+exp(-((ws/60-0.6e0)/0.4e0))), 6) as inv_strength,
    round(solar*ws/1000*1.000000001e0, 6) as vent_coef, round(case when pm25 is null then null else ln(1+greatest(pm25-20,0)) end, 6) as log_obs from chx""")
def inversion_strength(spark, sf):
    c = F.col
    return fx.chx(spark, sf).select(
        "city", "t", _r(physics.inversion_strength(c("rh") / 20, c("ws") / 60)).alias("inv_strength"),
        _rt(physics.ventilation(c("solar"), c("ws"))).alias("vent_coef"),
        _r(physics.log_obs(c("pm25") - 20)).alias("log_obs"))


@query("wind_uv", "chx", """with a as (select city, t, ws/3.6e0*sin(radians(wd)) as u, ws/3.6e0*cos(radians(wd)) as v from chx)
    select city, t, round(u,6) as u, round(v,6) as v,
    round(((270 - degrees(atan2(-v,-u))) + 720) % 360, 4) as wd_back from a where u is not null and abs(u) > 0.01 and abs(v) > 0.01""")
def wind_uv(spark, sf):
    u, v = geo.wind_uv(geo.kmh_to_ms(F.col("ws")), F.col("wd"))
    d = fx.chx(spark, sf).select("city", "t", u.alias("u"), v.alias("v")).filter("u is not null and abs(u) > 0.01 and abs(v) > 0.01")
    return d.select("city", "t", _r(F.col("u")).alias("u"), _r(F.col("v")).alias("v"),
                    _r(geo.wind_direction(F.col("u"), F.col("v")), 4).alias("wd_back"))


@query("dayness", "chx", """with a as (select city, t, lat, lon, radians(-23.44*cos(radians(360e0/365e0*(dayofyear(t)+10)))) as d1,
      radians((((hour(t) + minute(t)/60e0 + lon*24/360) % 24) - 12)*15) as h1,
      radians(23.45*sin(radians(360e0/365e0*(dayofyear(t)-81)))) as d2, radians(15e0*(hour(t)-12) + (lon-82.5e0)/15*15) as h2 from chx)
    select city, t, round(least(greatest(sin(radians(lat))*sin(d1)+cos(radians(lat))*cos(d1)*cos(h1),0),1),6) as solar_time,
      round(least(greatest(sin(radians(lat))*sin(d2)+cos(radians(lat))*cos(d2)*cos(h2),0),1),6) as zone_time from a""")
def dayness(spark, sf):
    c = F.col
    return fx.chx(spark, sf).select(
        "city", "t", _r(geo.dayness(c("t"), c("lat"), c("lon"), "solar_time")).alias("solar_time"),
        _r(geo.dayness(c("t"), c("lat"), c("lon"), "zone_time")).alias("zone_time"))


def band_values(variant: str) -> str:
    return ", ".join(
        f"('{p}', {k}, {lo!r}::double, {hi!r}::double, {il}, {ih})"
        for p in aqi.POLLUTANTS for k, (lo, hi, il, ih) in enumerate(aqi.bands(p, variant)))


def _sub_sql(variant: str) -> str:
    x = "value" if variant == "contiguous" else "(case when metric='CO' then greatest(value,0)/1000 else greatest(value,0) end)"
    form = f"(b.ih-b.il)/(b.hi-b.lo)*({x}-b.lo)+b.il" if variant == "contiguous" else f"b.il + ({x}-b.lo)/(b.hi-b.lo)*(b.ih-b.il)"
    return f"""(select o.seq, first(cast(round_even({form}, 0) as integer) order by b.k) as si
        from obs o join (values {band_values(variant)}) b(p,k,lo,hi,il,ih) on o.metric = b.p and {x} <= b.hi group by o.seq)"""


@query("aqi_sub_index", "obs", f"""select o.seq, o.metric, a.si as contiguous, coalesce(g.si, 500) as gapped
    from obs o left join {_sub_sql('contiguous')} a on a.seq=o.seq left join {_sub_sql('gapped')} g on g.seq=o.seq""")
def aqi_sub_index(spark, sf):
    return fx.obs(spark, sf).select(
        "seq", "metric", aqi.sub_index_long(F.col("metric"), F.col("value")).alias("contiguous"),
        aqi.sub_index_long(F.col("metric"), F.col("value"), "gapped").alias("gapped"))


@query("aqi_composite", "ch", f"""with l as (select city, t, 'PM2.5' as p, 1 as o, pm25 as v from ch union all
      select city, t, 'PM10', 2, pm10 from ch union all select city, t, 'O3', 3, o3 from ch),
    s as (select l.city, l.t, l.p, l.o, first(cast(round_even((b.ih-b.il)/(b.hi-b.lo)*(l.v-b.lo)+b.il, 0) as integer) order by b.k) as si
      from l join (values {band_values('contiguous')}) b(p,k,lo,hi,il,ih) on l.p=b.p and l.v <= b.hi group by 1,2,3,4)
    select city, t, max(si) as aqi, first(p order by si desc, o) as dominant,
      string_agg(concat(p,'=',si), ',' order by o) as subs from s group by city, t""")
def aqi_composite(spark, sf):
    c = F.col
    comp = aqi.composite({"PM2.5": c("pm25"), "PM10": c("pm10"), "O3": c("o3")})
    text = F.array_join(F.transform(F.map_entries(comp["sub_indices"]),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return (fx.ch(spark, sf).filter("coalesce(pm25, pm10, o3) is not null")
            .select("city", "t", comp["aqi"].alias("aqi"), comp["dominant"].alias("dominant"), text.alias("subs")))


_CAT = """case when {a} between 0 and 50 then 'Good' when {a} between 51 and 100 then 'Satisfactory'
    when {a} between 101 and 200 then 'Moderate' when {a} between 201 and 300 then 'Poor'
    when {a} between 301 and 400 then 'Very Poor' else 'Severe' end"""
_MSG = "case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in aqi.HEALTH_MESSAGES.items()) + " end"


@query("aqi_category", "obs", f"""with a as (select seq, cast(floor(value*1.2) as integer) as aqi from obs)
    select seq, aqi, {_CAT.format(a='aqi')} as category, {_MSG.format(c=_CAT.format(a='aqi'))} as message from a""")
def aqi_category(spark, sf):
    d = fx.obs(spark, sf).select("seq", F.floor(F.col("value") * F.lit(1.2)).cast("int").alias("aqi"))
    cat = aqi.category(F.col("aqi"))
    return d.select("seq", "aqi", cat.alias("category"), aqi.health_message(cat).alias("message"))


@query("action_stage", "obs", """select seq, case when floor(value*1.2) >= 451 then 4 when floor(value*1.2) >= 401 then 3
    when floor(value*1.2) >= 301 then 2 when floor(value*1.2) >= 201 then 1 else 0 end as stage from obs""")
def action_stage(spark, sf):
    return fx.obs(spark, sf).select("seq", aqi.action_stage(F.floor(F.col("value") * F.lit(1.2))).alias("stage"))


@query("conc_band", "obs", """select seq, metric, case when metric='PM10' then (case when value<=50 then 'Good' when value<=100 then 'Satisfactory'
      when value<=250 then 'Moderate' when value<=350 then 'Poor' when value<=430 then 'Very Poor' else 'Severe' end)
    when metric='O3' then (case when value<=50 then 'Good' when value<=100 then 'Satisfactory' when value<=168 then 'Moderate'
      when value<=208 then 'Poor' when value<=748 then 'Very Poor' else 'Severe' end)
    else (case when value<=30 then 'Good' when value<=60 then 'Satisfactory' when value<=90 then 'Moderate' when value<=120 then 'Poor'
      when value<=250 then 'Very Poor' else 'Severe' end) end as band from obs""")
def conc_band(spark, sf):
    return fx.obs(spark, sf).select("seq", "metric", aqi.conc_band(F.col("metric"), F.col("value")).alias("band"))


_GROW = "(1+0.12e0*least(greatest(({rh}-40)/60,0),1))"
_EST = "(greatest(coalesce(pm25,0),0)*0.00023e0*" + _GROW.format(rh="coalesce(rh*3,50)") + ")"


@query("aod_from_pm", "chx", f"""select city, t, round({_EST}*1.000000001e0, 8) as aod_calc,
    round(coalesce(0.7e0*aod + 0.3e0*{_EST}, {_EST})*1.000000001e0, 8) as aod_fused from chx""")
def aod_from_pm(spark, sf):
    pm, rh = F.coalesce("pm25", F.lit(0.0)), F.coalesce(F.col("rh") * 3, F.lit(50.0))
    return fx.chx(spark, sf).select("city", "t", _rt(physics.aod_from_pm(pm, rh), 8).alias("aod_calc"),
                                    _rt(physics.aod_fused(pm, rh, F.col("aod")), 8).alias("aod_fused"))


@query("radiation_dimming", "chx", """select city, t, round(solar*exp(-least(greatest(aod,0),6)),6) as sw_surface,
    round(solar*(1-exp(-least(greatest(aod,0),6))),6) as dimming_wm2,
    round(case when solar>1 then least(greatest(1-exp(-least(greatest(aod,0),6)),0),1) else 0e0 end,6) as dimming_frac,
    round(-2e0*(case when solar>1 then 1-exp(-least(greatest(aod,0),6)) else 0e0 end)*solar/100,6) as cooling_c from chx where aod is not null""")
def radiation_dimming(spark, sf):
    sw, a = F.col("solar"), F.col("aod")
    frac = physics.dimming_fraction(sw, a)
    return fx.chx(spark, sf).filter("aod is not null").select(
        "city", "t", _r(physics.attenuated(sw, a)).alias("sw_surface"), _r(physics.dimming_wm2(sw, a)).alias("dimming_wm2"),
        _r(frac).alias("dimming_frac"), _r(physics.surface_cooling(frac, sw)).alias("cooling_c"))


_BASE = """least(greatest((150+1450*(0.45e0+0.55e0*greatest(sin(pi()*(hour(t)-5.5e0)/14),0)))*(1-0.35e0*cloud/100),150),2200)"""


@query("mixing_height", "chx", f"""with a as (select city, t, {_BASE} as b, 0.30e0*{_EST} as loss from chx)
    select city, t, round(b,6) as pblh_base, round(greatest(b*(1-0.25e0*least(greatest(loss,0),1)),150),6) as pblh_coupled,
    round(least(greatest(0.25e0*loss,0),1)*1.000000001e0,9) as feedback from a""")
def mixing_height(spark, sf):
    pm, rh = F.coalesce("pm25", F.lit(0.0)), F.coalesce(F.col("rh") * 3, F.lit(50.0))
    base = physics.mixing_height_base(F.hour("t"), F.col("cloud"))
    h, s = physics.mixing_height_coupled(base, pm, rh)
    return fx.chx(spark, sf).select("city", "t", _r(base).alias("pblh_base"), _r(h).alias("pblh_coupled"), _rt(s, 9).alias("feedback"))


@query("stability", "chx", """with a as (select city, t, temp+273.15e0 as ts, temp+273.15e0 - 6 + (city%4)*3 as ta, ws/10 as us, ws/8 as ua, temp - 6 + (city%4)*3 - temp as dt from chx),
    b as (select *, 0.5e0*(ts+ta) as tm from a),
    c as (select *, ts*power(1000/1013.25e0, 287.05e0*0.0098e0/9.81e0) as th_s,
        ta*power(1000/(1013.25e0*exp(-(770e0*9.81e0)/(287.05e0*tm))), 287.05e0*0.0098e0/9.81e0) as th_a from b),
    d as (select *, 9.81e0/tm*(th_a-th_s)*760e0/greatest(power(ua-us,2)+power(0.5e0,2),1e-4) as rib from c where us is not null)
    select city, t, round(greatest(dt,0),6) as lapse_k, round(rib,5) as rib,
      case when rib>1 then 4 when rib>0.25 then 3 when rib>=0 then 2 else 1 end as klass from d""")
def stability(spark, sf):
    c = F.col
    d = fx.chx(spark, sf).filter("ws is not null").select(
        "city", "t", "temp", (c("temp") + F.lit(273.15)).alias("ts"), (c("temp") - 6 + (c("city") % 4) * 3).alias("t925"),
        (c("ws") / 10).alias("us"), (c("ws") / 8).alias("ua"))
    zero = F.lit(0.0)
    rib = physics.bulk_richardson(c("ts"), c("t925") + F.lit(273.15), 10.0, 770.0, c("us"), zero, c("ua"), F.lit(0.5))
    return d.select("city", "t", _r(physics.inversion_lapse(c("temp"), c("t925"))).alias("lapse_k"),
                    _r(rib, 5).alias("rib"), physics.stability_class(rib).alias("klass"))


INV_SQL = """p as (select *, least(greatest(1/(1+exp(-0.8e0*(greatest(t925-temp,0)-2)))*(1/(1+exp(1.2e0*(wind-4)))),0),1) as prob,
      1/(1+exp(1.2e0*(wind-4))) as calm from s),
    q as (select *, greatest(t925-temp,0) as strength, case when greatest(t925-temp,0)>1 then 287.05e0*288.15e0/9.81e0*ln(1013.25e0/925) else 250e0 end as hgt,
      least(greatest(0.55e0*prob+0.25e0*calm+0.2e0*(1-least(greatest((pblh-250)/1800,0),1)),0),1) as trap from p)"""
INV_SRC = "s as (select city, t, temp, temp - 3 + (city%4)*2 as t925, ws/5 as wind, 300e0 + cloud*15 as pblh from chx where ws is not null)"


def inversion_frame(spark, sf):
    c = F.col
    s = fx.chx(spark, sf).filter("ws is not null").select(
        "city", "t", "temp", (c("temp") - 3 + (c("city") % 4) * 2).alias("t925"), (c("ws") / 5).alias("wind"),
        (F.lit(300.0) + c("cloud") * 15).alias("pblh"))
    d = physics.inversion_diagnostics(c("temp"), c("t925"), c("wind"), c("pblh"))
    return s.select("*", *[v.alias(k) for k, v in d.items()])


@query("inversion_diag", "chx", f"""with {INV_SRC}, {INV_SQL}
    select city, t, round(strength,6) as strength_k, round(hgt,4) as height_m, round(prob,6) as probability, round(trap,6) as trapping_idx from q""")
def inversion_diag(spark, sf):
    return inversion_frame(spark, sf).select("city", "t", _r(F.col("strength_k")).alias("strength_k"), _r(F.col("height_m"), 4).alias("height_m"),
                                             _r(F.col("probability")).alias("probability"), _r(F.col("trapping_idx")).alias("trapping_idx"))


@query("ventilation_stagnation", "chx", f"""with {INV_SRC},
    a as (select *, (t925-temp)/(287.05e0*288.15e0/9.81e0*ln(1013.25e0/925))*1000 as stab from s)
    select city, t, round(stab,6) as stability, round(pblh*(wind+0.35e0)*1.000000001e0,4) as vent_idx,
      round(least(greatest(0.2e0*(1-least(greatest((pblh-200)/2000,0),1))+0.5e0*least(greatest(1-(wind-0.5e0)/6,0),1)
        +0.3e0*least(greatest(1-(stab+2)/8,0),1),0),1),6) as stagnation from a""")
def ventilation_stagnation(spark, sf):
    c = F.col
    st = physics.lapse_stability(c("temp"), c("t925"))
    return inversion_frame(spark, sf).select("city", "t", _r(st).alias("stability"), _rt(physics.ventilation_index(c("pblh"), c("wind")), 4).alias("vent_idx"),
                                             _r(physics.stagnation_index(c("pblh"), c("wind"), st)).alias("stagnation"))


@query("pressure_height", "chx", """select city, t, round(287.05e0*(temp+273.15e0)/9.81e0*ln(1013.25e0/925),4) as z925,
    round(287.05e0*(temp+273.15e0)/9.81e0*ln(1013.25e0/850),4) as z850,
    round(925*exp((287.05e0*288.15e0/9.81e0*ln(1013.25e0/925) - (200 + city*10))/(287.05e0*(temp - 4 + 273.15e0)/9.81e0)),4) as psfc from chx""")
def pressure_height(spark, sf):
    tk = F.col("temp") + F.lit(273.15)
    return fx.chx(spark, sf).select(
        "city", "t", _r(physics.pressure_height(F.lit(925.0), tk), 4).alias("z925"), _r(physics.pressure_height(F.lit(850.0), tk), 4).alias("z850"),
        _r(physics.surface_pressure(F.lit(200.0) + F.col("city") * 10, F.col("temp") - 4), 4).alias("psfc"))


@query("fire_point_emission", "fire", "select ok, ln, " + ", ".join(
    f"round(frp*0.368e0*3600*1000*{ef}, 1) as {sp}" for sp, ef in physics.EMISSION_FACTORS.items()) + " from fire")
def fire_point_emission(spark, sf):
    em = physics.fire_emission(F.col("frp"))
    return fx.fire(spark, sf).select("ok", "ln", *[_r(c, 1).alias(sp) for sp, c in em.items()])


_DIURNAL_SQL = "[" + ", ".join(f"{x}::double" for x in physics.DIURNAL) + "]"


@query("urban_diurnal", "field", f"""with a as (select distinct hour_idx, i, j from field)
    select hour_idx, i, j, round(180e0*1000/24*(0.8e0/21*111.13e0)*(0.8e0/19*111.13e0*cos(radians(28.6e0)))
      * list_extract({_DIURNAL_SQL}, cast(((cast(round_even(hour_idx + (77.2e0-82.5e0)/15, 0) as integer) + 24) % 24) + 1 as bigint)), 4) as g_per_h from a""")
def urban_diurnal(spark, sf):
    from airlake.operators.fires import urban_base

    g = fx.field(spark, sf).select(F.col("hour_idx").alias("hour"), "i", "j")
    return urban_base(g, nx=20, ny=22).select(F.col("hour").alias("hour_idx"), "i", "j", _r(F.col("g_per_h"), 4).alias("g_per_h"))


@query("season_factor", "", """select o_orderkey as seq, round(power(cos((dayofyear(o_orderdate)-309)/45e0*pi()),2),6) as season from orders""")
def season_factor(spark, sf):
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), _r(physics.season_factor(F.dayofyear("o_orderdate"))).alias("season"))


@query("local_time", "obs", "select seq, observed_at_utc + interval 330 minute as local_t from obs")
def local_time(spark, sf):
    return fx.obs(spark, sf).select("seq", timing.local_time(F.col("observed_at_utc")).alias("local_t"))


@query("timeline_format", "obs", "select seq, strftime(observed_at_utc, '%Y-%m-%d %H:00:00') as hourly_iso from obs")
def timeline_format(spark, sf):
    return fx.obs(spark, sf).select("seq", timing.timeline_text(F.col("observed_at_utc")).alias("hourly_iso"))
