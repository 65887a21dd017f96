"""Radar backscatter expressions on linear digital numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geotransfer.functions.numeric import _col, between, finite
from geotransfer.schemas import L_BAND, VALID_QA


def gamma0_db(dn) -> Column:
    """20*log10(DN) - 83 for finite positive DN, else NULL."""
    v = _col(dn).cast("double")
    return F.when(finite(v) & (v > 0), F.lit(20.0) * F.log10(v) - F.lit(83.0))


def rfdi(hh, hv) -> Column:
    """Normalised difference of the two linear powers; NULL unless both DN are positive."""
    h, v = _col(hh).cast("double"), _col(hv).cast("double")
    ph, pv = h * h, v * v
    return F.when(finite(ph) & finite(pv) & (h > 0) & (v > 0), F.try_divide(ph - pv, ph + pv))


def with_radar_features(df: DataFrame, hh: str = "HH", hv: str = "HV",
                        drop_raw: bool = True) -> DataFrame:
    """Add the four L-band features in their fixed order."""
    lacking = {hh, hv} - set(df.columns)
    if lacking:
        raise ValueError(f"raw radar columns missing: {sorted(lacking)}")
    out = df.withColumns({
        "palsar_hh_db": gamma0_db(hh),
        "palsar_hv_db": gamma0_db(hv),
        "palsar_hh_minus_hv_db": gamma0_db(hh) - gamma0_db(hv),
        "palsar_rfdi": rfdi(hh, hv),
    })
    return out.drop(hh, hv) if drop_raw else out


def radar_valid(qa="palsar_qa") -> Column:
    """Composite validity: land class, four features present and inside sensor ranges."""
    return (qa_is_valid(qa)
            & between("palsar_hh_db", -60.0, 20.0)
            & between("palsar_hv_db", -60.0, 20.0)
            & between("palsar_rfdi", -1.0, 1.0)
            & finite("palsar_hh_minus_hv_db"))


def physics_violations(df: DataFrame, hh: str | None = None, hv: str | None = None) -> DataFrame:
    """One row of counts: raw values not above zero, missing features, out-of-range features."""
    raw = F.lit(False)
    for c in (hh, hv):
        if c:
            raw = raw | F.coalesce(F.col(c) <= 0, F.lit(False))
    missing = F.lit(False)
    for c in L_BAND:
        missing = missing | ~finite(c)
    return df.agg(F.count_if(raw).alias("raw_not_positive"), F.count_if(missing).alias("missing_feature"),
                  *[F.count_if(finite(c) & ~between(c, lo, hi)).alias(f"{c}_out_of_range")
                    for c, lo, hi in (("palsar_hh_db", -60.0, 20.0), ("palsar_hv_db", -60.0, 20.0),
                                      ("palsar_rfdi", -1.0, 1.0))])


def require_physics(df: DataFrame, hh: str | None = None, hv: str | None = None) -> DataFrame:
    """Raise with the counts of every check of ``physics_violations`` that found a row."""
    found = {k: v for k, v in physics_violations(df, hh, hv).first().asDict().items() if v}
    if found:
        raise ValueError(f"radar physics check failed: {found}")
    return df


def qa_is_valid(value) -> Column:
    """Membership in the documented land classes; unreadable input is False."""
    return F.coalesce(_col(value).try_cast("int").isin(*VALID_QA), F.lit(False))

