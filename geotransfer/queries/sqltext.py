"""SQL text of the projection formulas for the oracle side (independent of the column code)."""

from __future__ import annotations

import math


def albers_sql(lon: str, lat: str) -> tuple[str, str]:
    a, f = 6378137.0, 1 / 298.257222101
    e2 = 2 * f - f * f
    e = math.sqrt(e2)

    def q_of(deg):
        s = math.sin(math.radians(deg))
        return (1 - e2) * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)

    def m_of(deg):
        s = math.sin(math.radians(deg))
        return math.cos(math.radians(deg)) / math.sqrt(1 - e2 * s * s)

    n = (m_of(29.5) ** 2 - m_of(45.5) ** 2) / (q_of(45.5) - q_of(29.5))
    c = m_of(29.5) ** 2 + n * q_of(29.5)
    rho0 = a * math.sqrt(c - n * q_of(23.0)) / n
    s = f"sin(radians({lat}))"
    q = f"({1 - e2!r} * ({s} / (1e0 - {e2!r} * {s} * {s}) + atanh({e!r} * {s}) / {e!r}))"
    rho = f"({a!r} * sqrt({c!r} - {n!r} * {q}) / {n!r})"
    th = f"({n!r} * radians({lon} + 96e0))"
    return f"({rho} * sin({th}))", f"({rho0!r} - {rho} * cos({th}))"


def utm_sql(lon: str, lat: str) -> tuple[str, str]:
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    r = 0.9996 * a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    al = [n / 2 - 2 / 3 * n ** 2 + 5 / 16 * n ** 3 + 41 / 180 * n ** 4,
          13 / 48 * n ** 2 - 3 / 5 * n ** 3 + 557 / 1440 * n ** 4,
          61 / 240 * n ** 3 - 103 / 140 * n ** 4, 49561 / 161280 * n ** 4]
    e = math.sqrt(f * (2 - f))
    s = f"sin(radians({lat}))"
    # Conformal latitude by the eccentricity form.
    t = f"sinh(atanh({s}) - {e!r} * atanh({e!r} * {s}))"
    d = f"radians({lon} - 117e0)"
    xi, eta = f"atan2({t}, cos({d}))", f"atanh(sin({d}) / sqrt(1e0 + {t} * {t}))"
    east, north = [eta], [xi]
    for j, aj in enumerate(al, 1):
        east.append(f"{aj!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})")
        north.append(f"{aj!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})")
    return f"(500000e0 + {r!r} * ({' + '.join(east)}))", f"({r!r} * ({' + '.join(north)}))"
