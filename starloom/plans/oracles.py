"""The same queries in plain SQL for an independent engine: nested loops and brute force where the operators use cells."""

from __future__ import annotations

from ..sources.views import with_views

R = "radians"


def _chord(a: str, b: str) -> str:
    def u(p: str) -> list[str]:
        return [f"cos({R}({p}dec)) * cos({R}({p}ra))", f"cos({R}({p}dec)) * sin({R}({p}ra))", f"sin({R}({p}dec))"]

    return "sqrt(" + " + ".join(f"power({x} - {y}, 2)" for x, y in zip(u(a), u(b), strict=True)) + ")"


def _sep(a: str, b: str) -> str:
    return f"degrees(asin(least(1e0, {_chord(a, b)} / 2e0))) * 72e2"


def _mod(x: str, m: str = "360e0") -> str:
    return f"((({x}) % {m} + {m}) % {m})"


def _east(ra: str, ra0: str, dec: str) -> str:
    return f"(({_mod(f'{ra} - {ra0} + 180e0')}) - 180e0) * cos({R}({dec})) * 36e2"


def _ell(e: str, n: str, pa: str, ba: str) -> str:
    return f"sqrt(power(({e}) * sin({R}({pa})) + ({n}) * cos({R}({pa})), 2) + power((({n}) * sin({R}({pa})) - ({e}) * cos({R}({pa}))) / {ba}, 2))"


def _pixel(ra: str, dec: str, ra0: str, dec0: str, scale: str, crpix: str) -> tuple[str, str]:
    below = f"(sin({R}({dec0})) * sin({R}({dec})) + cos({R}({dec0})) * cos({R}({dec})) * cos({R}({ra} - {ra0})))"
    xi = f"degrees(cos({R}({dec})) * sin({R}({ra} - {ra0})) / {below}) * 36e2"
    eta = f"degrees((cos({R}({dec0})) * sin({R}({dec})) - sin({R}({dec0})) * cos({R}({dec})) * cos({R}({ra} - {ra0}))) / {below}) * 36e2"
    return f"({crpix} - 1 - {xi} / {scale})", f"({crpix} - 1 + {eta} / {scale})"


_R26 = "CASE WHEN sma_sb26 > 0 THEN sma_sb26 ELSE d26 * 30e0 END"


def _iso(sb: float) -> str:
    more = max(sb - 26.0, 0.0)
    return f"""(CASE WHEN sma_sb26 > 0 THEN sma_sb26 + greatest(CASE WHEN sma_sb25 > 0 THEN sma_sb26 - sma_sb25 ELSE 0.25e0 * sma_sb26 END, 0.1e0 * sma_sb26) * {more}e0
      ELSE d26 * 30e0 + d26 * 30e0 * 0.25e0 * {more}e0 END)"""


ATLAS = f"""atlas AS (SELECT sga_id, galaxy, ra, dec, z_leda, d26, group_name, group_ra, {_R26} AS r26, CASE WHEN ba > 0 AND ba <= 1 THEN ba ELSE 1e0 END AS ba,
  CASE WHEN isnan(pa) THEN 0e0 ELSE pa END AS pa, greatest(round_even(1.5e0 * d26 * 60e0 / 0.262e0, 0), 64)::INT AS size_px, {_iso(28.0)} AS r_iso FROM v_galaxies),
pos AS (SELECT *, sga_id AS id, sqrt(2e0) * 0.5e0 * size_px * 0.262e0 AS half_diag FROM atlas WHERE z_leda > 0 AND z_leda < 5e-2)"""


def _resolve(source: str, to: str) -> str:
    return f"""{to}_hits AS (SELECT p.id, b.hemisphere, b.brickname AS brick, b.dec AS bdec, row_number() OVER (PARTITION BY p.id, b.hemisphere ORDER BY round({_chord("p.", "b.")}, 12), b.brickname) AS rk
  FROM {source} p JOIN v_bricks b ON p.dec BETWEEN b.dec1 AND b.dec2 AND {_mod("p.ra - b.ra1")} <= {_mod("b.ra2 - b.ra1")} WHERE nexp_g >= 1 AND nexp_r >= 1 AND nexp_z >= 1),
{to}_both AS (SELECT i.id, s.brick AS sb, n.brick AS nb, n.bdec FROM (SELECT DISTINCT id FROM {to}_hits) i
  LEFT JOIN (SELECT * FROM {to}_hits WHERE rk = 1 AND hemisphere = 'south') s USING (id) LEFT JOIN (SELECT * FROM {to}_hits WHERE rk = 1 AND hemisphere = 'north') n USING (id)),
{to} AS (SELECT id, CASE WHEN nb IS NOT NULL AND (bdec >= 32.375e0 OR sb IS NULL) THEN nb ELSE sb END AS brick,
  CASE WHEN nb IS NOT NULL AND (bdec >= 32.375e0 OR sb IS NULL) THEN 'north' ELSE 'south' END AS hemisphere FROM {to}_both)"""


def _blocked(source: str, to: str, exclude: str) -> str:
    return f"""{to} AS (SELECT DISTINCT id FROM (SELECT p.id, p.half_diag, g.r26, g.ba, g.pa, {_east("p.ra", "g.ra", "p.dec")} AS e, (p.dec - g.dec) * 36e2 AS n
  FROM {source} p JOIN atlas g ON g.sga_id <> p.{exclude} AND abs(p.dec - g.dec) < 0.5e0) q
  WHERE sqrt(e * e + n * n) <= r26 * 1.5e0 + half_diag AND {_ell("e", "n", "pa", "ba")} <= r26 * 1.5e0 + half_diag / ba)"""


TARGETS = f"""{ATLAS},
{_resolve("pos", "tr")},
{_blocked("pos", "tb", "sga_id")},
targets AS (SELECT pos.*, tr.brick, tr.hemisphere FROM pos JOIN tr USING (id) WHERE id NOT IN (SELECT id FROM tb))"""

_F = _ell(f"sin({R}(pa_deg))", f"cos({R}(pa_deg))", "pa", "ba")
CAND = f"""{TARGETS},
cp AS (SELECT *, ((45 * k + 7 * sga_id) % 360)::DOUBLE AS pa_deg, ((13 * sga_id + 29 * k) % 50) / 1e2 AS slack FROM (SELECT *, unnest(range(0, 8)) AS k FROM targets)),
cs AS (SELECT *, (r_iso / ({_F}) + half_diag) * (1e0 + slack) AS sep_arcsec FROM cp),
cd AS (SELECT *, least(1e0, greatest(-1e0, sin({R}(dec)) * cos({R}(sep_arcsec / 36e2)) + cos({R}(dec)) * sin({R}(sep_arcsec / 36e2)) * cos({R}(pa_deg)))) AS s FROM cs),
cand AS (SELECT sga_id * 8 + k AS id, sga_id AS parent_sga_id, k::INT AS k, pa_deg, sep_arcsec, size_px, half_diag, brick AS parent_brick, degrees(asin(s)) AS dec,
  {_mod(f"ra + degrees(atan2(sin({R}(pa_deg)) * sin({R}(sep_arcsec / 36e2)) * cos({R}(dec)), cos({R}(sep_arcsec / 36e2)) - sin({R}(dec)) * s))")} AS ra FROM cd)"""

_BX, _BY = _pixel("c.ra", "c.dec", "b.ra", "b.dec", "112.5e0", "4.5e0")
FUNNEL = f"""{CAND},
{_resolve("cand", "cr")},
{_blocked("cand", "cb", "parent_sga_id")},
ct AS (SELECT c.*, coalesce(cr.brick, '') AS brick, coalesce(cr.hemisphere, '') AS hemisphere, cb.id IS NULL AS clear FROM cand c LEFT JOIN cr USING (id) LEFT JOIN cb ON cb.id = c.id),
cx AS (SELECT c.*, (b.nexp_g * 31 + b.nexp_r * 7 + b.nexp_z) % 500 AS sample_id, coalesce(b.nexp_r % 9 = 4, false) AS failed, {_BX} AS px, {_BY} AS py FROM ct c LEFT JOIN v_bricks b ON b.brickname = c.brick),
cl AS (SELECT *, least(greatest(trunc(px - 1), 0), 8) AS x0, least(greatest(trunc(px + 1), 0), 8) AS x1, least(greatest(trunc(py - 1), 0), 8) AS y0, least(greatest(trunc(py + 1), 0), 8) AS y1 FROM cx),
gp AS (SELECT cl.id, count(*) AS n FROM cl JOIN v_pixels p ON p.sample_id = cl.sample_id AND (p.mask & 4096) <> 0 AND p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1 GROUP BY 1),
tested AS (SELECT parent_sga_id, k, ra, dec, pa_deg, sep_arcsec, size_px, brick, hemisphere, (brick = parent_brick)::INT AS in_parent_brick,
  CASE WHEN brick = '' THEN 'footprint' WHEN NOT clear THEN 'sga_overlap' WHEN failed THEN 'fetch' WHEN greatest(x1 - x0, 0) * greatest(y1 - y0, 0) / 4e0 < 0.8e0 THEN 'coverage' WHEN coalesce(gp.n, 0) > 0 THEN 'sga_maskbit' ELSE '' END AS reason
  FROM cl LEFT JOIN gp USING (id)),
done AS (SELECT * REPLACE (CASE WHEN reason <> '' THEN reason WHEN (parent_sga_id * 8 + k) % 10 = 3 THEN 'error' WHEN (parent_sga_id * 8 + k) % 10 = 7 THEN 'coverage' ELSE '' END AS reason) FROM tested),
outcome AS (SELECT *, CASE WHEN reason = '' THEN 'accepted' ELSE 'rejected' END AS status FROM done)"""

COMPANIONS = f"""{ATLAS},
cm AS (SELECT pos.sga_id, pos.ra, pos.dec, pos.r26, pos.size_px * 0.262e0 / 2 AS half, t.flux_r AS tf FROM pos LEFT JOIN v_tractor t ON t.ref_cat = 'L3' AND t.ref_id = pos.sga_id AND t.grp = pos.sga_id),
cc AS (SELECT sga_id, tf, half, r26, row_no, flux_r / tf AS ratio, {_east("t.ra", "cm.ra", "cm.dec")} AS e, (t.dec - cm.dec) * 36e2 AS n
  FROM cm JOIN v_tractor t ON t.grp = cm.sga_id WHERE tf > 0 AND t.ref_cat <> 'L3' AND trim(t.type) NOT IN ('PSF', 'DUP')),
cb AS (SELECT sga_id, ratio, sqrt(e * e + n * n) / r26 AS sep, row_number() OVER (PARTITION BY sga_id ORDER BY ratio DESC, row_no) AS rk FROM cc WHERE abs(e) < half AND abs(n) < half AND sqrt(e * e + n * n) > 0.25e0 * r26),
comp AS (SELECT cm.sga_id, CASE WHEN tf > 0 THEN coalesce(ratio, 0e0) ELSE 'NaN'::DOUBLE END AS companion_ratio, CASE WHEN tf > 0 THEN coalesce(sep, 0e0) ELSE 'NaN'::DOUBLE END AS companion_sep_r26
  FROM cm LEFT JOIN (SELECT * FROM cb WHERE rk = 1) b USING (sga_id))"""


def _cd_pixel(ra: str, dec: str, f: str = "", crpix: tuple[str, str] = ("4.5e0", "4.5e0")) -> tuple[str, str]:
    """A position in a frame (ra0, dec0, cd11 ...): the plane's offsets through the inverse of its matrix."""
    east, north = _pixel(ra, dec, f"{f}ra0", f"{f}dec0", "1e0", "1e0")
    xi, eta, det = f"(-{east})", north, f"({f}cd11 * {f}cd22 - {f}cd12 * {f}cd21)"
    return f"(({f}cd22 * {xi} - {f}cd12 * {eta}) / {det} + {crpix[0]} - 1)", f"(({f}cd11 * {eta} - {f}cd21 * {xi}) / {det} + {crpix[1]} - 1)"


def _cd_world(dx: str, dy: str) -> tuple[str, str]:
    """The position of pixel offsets from the reference pixel."""
    xi, eta = f"{R}((cd11 * ({dx}) + cd12 * ({dy})) / 36e2)", f"{R}((cd21 * ({dx}) + cd22 * ({dy})) / 36e2)"
    below = f"(cos({R}(dec0)) - {eta} * sin({R}(dec0)))"
    return _mod(f"ra0 + degrees(atan2({xi}, {below}))"), f"degrees(atan2(sin({R}(dec0)) + {eta} * cos({R}(dec0)), sqrt({xi} * {xi} + {below} * {below})))"


def _slopes(dx: float, dy: float) -> str:
    """je_x, je_y, jn_x, jn_y at pixel offsets from the reference pixel, by steps of a pixel."""
    (a, d), (ax, dx_), (ay, dy_) = (_cd_world(f"{x}e0", f"{y}e0") for x, y in ((dx, dy), (dx + 1, dy), (dx, dy + 1)))
    east = lambda to: f"({_mod(f'{to} - {a} + 180e0')} - 180e0) * cos({R}({d})) * 36e2"
    return f"{east(ax)} AS je_x, {east(ay)} AS je_y, ({dx_} - {d}) * 36e2 AS jn_x, ({dy_} - {d}) * 36e2 AS jn_y"


def _cd(k: str, scale: str) -> str:
    t, f, sh = f"{R}((({k} * 29) % 360)::DOUBLE)", f"CASE WHEN {k} % 2 = 0 THEN 1e0 ELSE -1e0 END", f"CASE WHEN {k} % 3 = 0 THEN 0.1e0 ELSE 0e0 END"
    return f"-{scale} * ({f}) * cos({t}) AS cd11, {scale} * (sin({t}) + ({sh})) AS cd12, {scale} * ({f}) * sin({t}) AS cd21, {scale} * cos({t}) AS cd22"


def _paint(shapes: str, to: str) -> str:
    """Every pixel against every shape of its frame."""
    x0, y0 = _cd_pixel("s.ra", "s.dec", "f.")
    return f"""{to}_at AS (SELECT f.sample_id, f.scale, je_x, je_y, jn_x, jn_y, radius, s.axis_ratio, s.angle, {x0} AS x0, {y0} AS y0 FROM frames f JOIN {shapes} s USING (sample_id)),
{to} AS (SELECT DISTINCT sample_id, y, x FROM {to}_at, (SELECT unnest(range(0, 8)) AS y) yy, (SELECT unnest(range(0, 8)) AS x) xx
  WHERE x0 > -radius / scale AND x0 < 8 + radius / scale AND y0 > -radius / scale AND y0 < 8 + radius / scale
  AND x BETWEEN floor(x0) - ceil(radius / scale) - 1 AND ceil(x0) + ceil(radius / scale) + 1 AND y BETWEEN floor(y0) - ceil(radius / scale) - 1 AND ceil(y0) + ceil(radius / scale) + 1
  AND {_ell("(je_x * (x - x0) + je_y * (y - y0))", "(jn_x * (x - x0) + jn_y * (y - y0))", "angle", "axis_ratio")} <= radius)"""


SHAPES = """shapes AS (SELECT grp AS sample_id, ra, dec, trim(type) IN ('PSF', 'DUP') AS point, CASE WHEN trim(type) IN ('PSF', 'DUP') THEN greatest(1.25e0 * 1.3e0, 1e0) ELSE greatest(2e0 * shape_r, 1e0) END AS radius,
  CASE WHEN trim(type) IN ('PSF', 'DUP') OR sqrt(shape_e1 * shape_e1 + shape_e2 * shape_e2) <= 0 THEN 1e0 ELSE (1e0 - sqrt(shape_e1 * shape_e1 + shape_e2 * shape_e2)) / (1e0 + sqrt(shape_e1 * shape_e1 + shape_e2 * shape_e2)) END AS axis_ratio,
  degrees(atan2(shape_e2, shape_e1)) * 0.5e0 AS angle FROM v_tractor WHERE trim(ref_cat) <> 'L3')"""
FRAMES = f"""{ATLAS},
fr AS (SELECT *, {_cd("sample_id", "scale")} FROM (SELECT sga_id AS sample_id, ra AS ra0, dec AS dec0, size_px * 0.262e0 / 8 AS scale, sqrt(2e0) * 0.5e0 * size_px * 0.262e0 AS half_diag FROM atlas WHERE sga_id IN (SELECT sample_id FROM v_pixels))),
frames AS (SELECT *, {_slopes(0, 0)} FROM fr)"""
PAINT_S = f"{SHAPES},\n{_paint('shapes', 'ps')}"
PAINT_G = f"""gshapes AS (SELECT f.sample_id, g.ra, g.dec, g.r26 AS radius, g.ba AS axis_ratio, g.pa AS angle FROM (SELECT *, ra0 AS ra, dec0 AS dec FROM frames) f JOIN atlas g ON {_sep("f.", "g.")} <= g.r26 + f.half_diag),
{_paint("gshapes", "pg")}"""
PACKED = f"""{FRAMES},
{PAINT_S},
{PAINT_G},
packed AS (SELECT p.*, (CASE WHEN ivar_g > 0 AND ivar_r > 0 AND ivar_z > 0 THEN 0 ELSE 1 END + CASE WHEN (mask & 252) <> 0 THEN 2 ELSE 0 END + CASE WHEN ps.x IS NULL THEN 0 ELSE 4 END + CASE WHEN pg.x IS NULL THEN 0 ELSE 8 END)::INT AS layers
  FROM v_pixels p LEFT JOIN ps ON ps.sample_id = p.sample_id AND ps.x = p.x AND ps.y = p.y LEFT JOIN pg ON pg.sample_id = p.sample_id AND pg.x = p.x AND pg.y = p.y)"""
VERDICT = f"""{PACKED},
verdict AS (SELECT sample_id, 1e0 - avg((layers & 1 <> 0)::INT) AS valid_frac, avg(((layers & 2) <> 0)::INT) AS bright_frac, avg(((layers & 4) <> 0)::INT) AS source_frac, avg(((layers & 8) <> 0)::INT) AS galaxy_frac, avg(((mask & 4096) <> 0)::INT) AS galaxy_bit_frac FROM packed GROUP BY 1)"""
VERDICT = VERDICT.replace("(layers & 1 <> 0)", "((layers & 1) <> 0)")

_R2 = "(power(x - 3.5e0, 2) + power(y - 3.5e0, 2))"
_FW, _BE = "((sample_id % 5) / 2e0 + 2e0)", "((sample_id % 17) / 1e1 + 2e0)"
_ALPHA = "({f} / (2e0 * sqrt(power(2e0, 1e0 / {b}) - 1e0)))"
STAMPS = """raw AS (SELECT sample_id, 'g' AS band, y, x, sci_g AS sci FROM v_pixels UNION ALL SELECT sample_id, 'r', y, x, sci_r FROM v_pixels UNION ALL SELECT sample_id, 'z', y, x, sci_z FROM v_pixels),
lifted AS (SELECT *, sci - min(sci) OVER (PARTITION BY sample_id, band) + 1e-3 AS v FROM raw),
stamps AS (SELECT sample_id, band, y, x, v / sum(v) OVER (PARTITION BY sample_id, band) AS value FROM lifted)"""


def _tv(kernel: str, name: str) -> str:
    return f"{name} AS (SELECT sample_id, band, 0.5e0 * sum(abs(value - q / tq)) AS tv FROM (SELECT *, sum(q) OVER (PARTITION BY sample_id, band) AS tq FROM (SELECT *, {kernel} AS q FROM stamps)) GROUP BY 1, 2)"


_GAUSS = f"exp(-0.5e0 * {_R2} / power({_FW} / 2.3548e0, 2))"
_MOFFAT28 = f"power(1e0 + {_R2} / power({_ALPHA.format(f=_FW, b='2.8e0')}, 2), -2.8e0)"
_MOFFAT = f"power(1e0 + {_R2} / power({_ALPHA.format(f=_FW, b=_BE)}, 2), -{_BE})"

FILES = f"""{TARGETS},
bh AS (SELECT DISTINCT brick, hemisphere FROM targets),
kinds AS (SELECT unnest(['image-g', 'image-r', 'image-z', 'invvar-g', 'invvar-r', 'invvar-z', 'psfsize-g', 'psfsize-r', 'psfsize-z', 'maskbits', 'tractor']) AS kind),
fn AS (SELECT *, CASE WHEN kind = 'tractor' THEN 'tractor-' || brick || '.fits' ELSE 'survey-' || brick || '-' || kind || '.fits.fz' END AS name FROM bh, kinds),
files AS (SELECT brick, kind, name, 'https://portal.example/coadd/' || hemisphere || CASE WHEN kind = 'tractor' THEN '/tractor/' || brick[1:3] ELSE '/coadd/' || brick[1:3] || '/' || brick END || '/' || name AS url,
  (length(brick) * 31 + length(kind) * 7 + ascii(right(brick, 1))) % 23 = 5 AS failed FROM fn)"""
PROFILES = """prof AS (SELECT *, fwhm / (2e0 * sqrt(power(2e0, 1e0 / b) - 1e0)) AS a FROM (SELECT vec_id AS sample_id, band, (vec_id % 5) / 2e0 + 2e0 + i / 1e1 AS fwhm, (vec_id % 17) / 1e1 + 2e0 AS b,
  (vec_id % 7 - 3) / 1e1 + 7e0 AS xa, (vec_id % 11 - 5) / 2e1 + 7e0 AS ya FROM embeddings, (SELECT unnest(range(0, 3)) AS i, unnest(['g', 'r', 'z']) AS band) bb) q)"""

_WX, _WY = _cd_pixel("ra2", "dec2", "", ("33e0", "30e0"))
_LISTED = r"(SELECT name, length, try_cast(split_part(name, '_', 2) AS BIGINT) AS sga_id, try_cast(regexp_extract(name, '_RA([-0-9.]+)_Dec([-0-9.]+)_size([-0-9.]+)\.jpeg$', 1) AS DOUBLE) AS ra, try_cast(regexp_extract(name, '_RA([-0-9.]+)_Dec([-0-9.]+)_size([-0-9.]+)\.jpeg$', 2) AS DOUBLE) AS dec, try_cast(regexp_extract(name, '_RA([-0-9.]+)_Dec([-0-9.]+)_size([-0-9.]+)\.jpeg$', 3) AS DOUBLE) AS size_arcsec FROM v_listing)"
BRIGHT = "SELECT source_id, ra, dec, phot_g_mean_mag, b FROM v_stars WHERE phot_g_mean_mag < 15 AND abs(b) >= 5"

_SQL = {
    "scan_galaxies": "SELECT sga_id, galaxy, round(ra, 9) AS ra, round(dec, 9) AS dec, round(z_leda, 6) AS z_leda, round(d26, 6) AS d26 FROM v_galaxies",
    "scan_bricks": "SELECT * FROM v_bricks",
    "scan_planes": "SELECT sample_id, count(*) AS n, sum(mask)::BIGINT AS mask_sum, max(y) AS y_max, max(x) AS x_max FROM v_pixels GROUP BY 1",
    "scan_tractor": "SELECT grp, count(*) AS n, round(sum(flux_r), 2) AS flux, count(*) FILTER (WHERE ref_cat = 'L3') AS n_atlas FROM v_tractor GROUP BY 1",
    "unit_vectors": f"SELECT sga_id, round(cos({R}(dec)) * cos({R}(ra)), 9) AS x, round(cos({R}(dec)) * sin({R}(ra)), 9) AS y, round(sin({R}(dec)), 9) AS z, round(2 * sin({R}(d26 / 60) / 2), 9) AS chord FROM v_galaxies",
    "elliptical_radius": f"WITH {ATLAS} SELECT sga_id, round({_ell('d26 * 10', 'd26 * -7', 'pa', 'ba')}, 6) AS radius FROM atlas",
    "offset_position": f"""WITH s AS (SELECT *, {R}(d26 * 3000e0 / 36e2) AS t, {R}(((sga_id * 7) % 360)::DOUBLE) AS p FROM v_galaxies), q AS (SELECT *, sin({R}(dec)) * cos(t) + cos({R}(dec)) * sin(t) * cos(p) AS sd FROM s)
      SELECT sga_id, round({_mod(f"ra + degrees(atan2(sin(p) * sin(t) * cos({R}(dec)), cos(t) - sin({R}(dec)) * sd))")}, 6) AS to_ra, round(degrees(asin(sd)), 6) AS to_dec FROM q""",
    "galaxy_geometry": f"WITH {ATLAS} SELECT sga_id, round(r26, 6) AS r26, round(ba, 6) AS ba, round(pa, 6) AS pa FROM atlas",
    "isophotal_radius": f"SELECT sga_id, round({_iso(28.0)}, 6) AS r28, round({_iso(25.5)}, 6) AS r25h FROM v_galaxies",
    "stamp_size": f"WITH {ATLAS} SELECT sga_id, size_px, round(sqrt(2e0) * 0.5e0 * size_px * 0.262e0, 6) AS half_diag FROM atlas",
    "tractor_shapes": f"WITH {SHAPES} SELECT sample_id AS grp, count(*) FILTER (WHERE point) AS n_point, round(sum(radius), 4) AS radius, round(sum(axis_ratio), 4) AS axis_ratio, round(sum(abs(angle)), 4) AS angle FROM shapes GROUP BY 1",
    "wcs_roundtrip": f"WITH g AS (SELECT sga_id, ra AS ra0, dec AS dec0, ra + d26 / 100 AS ra2, dec - d26 / 200 AS dec2, {_cd('sga_id', '0.262e0')} FROM v_galaxies), s AS (SELECT *, {_slopes(-0.5, 2.5)} FROM g) SELECT sga_id, round({_WX}, 4) AS x, round({_WY}, 4) AS y, round({_mod('ra2')}, 6) AS back_ra, round(dec2, 6) AS back_dec, round(je_x, 5) + 0e0 AS je_x, round(je_y, 5) + 0e0 AS je_y, round(jn_x, 5) + 0e0 AS jn_x, round(jn_y, 5) + 0e0 AS jn_y FROM s",
    "select_redshift": "SELECT sga_id, round(z_leda, 6) AS z_leda FROM v_galaxies WHERE z_leda > 0 AND z_leda < 5e-2",
    "resolve_bricks": f"WITH allpos AS (SELECT *, sga_id AS id FROM v_galaxies), {_resolve('allpos', 'tr')} SELECT id AS sga_id, brick, hemisphere FROM tr",
    "clearance_targets": f"WITH {ATLAS}, {_blocked('pos', 'tb', 'sga_id')} SELECT sga_id FROM pos WHERE id NOT IN (SELECT id FROM tb)",
    "overlapping": f"WITH {ATLAS} SELECT p.sga_id AS target, g.sga_id, round({_sep('p.', 'g.')}, 6) AS sep FROM pos p JOIN atlas g ON {_sep('p.', 'g.')} <= g.r26 + p.half_diag",
    "neighbours": f"WITH {ATLAS} SELECT p.sga_id, g.sga_id AS other, round({_chord('p.', 'g.')}, 8) AS chord FROM pos p JOIN atlas g ON {_chord('p.', 'g.')} <= 2 * sin({R}(120e0 / 36e2) / 2)",
    "galaxy_targets": f"WITH {TARGETS} SELECT sga_id, galaxy, round(ra, 6) AS ra, round(dec, 6) AS dec, round(d26, 6) AS d26, size_px, group_name, round(group_ra, 6) AS group_ra, brick, hemisphere FROM targets",
    "subsample": f"""WITH {TARGETS}, rk AS (SELECT *, row_number() OVER (ORDER BY ra, sga_id) - 1 AS i, count(*) OVER () AS n FROM targets),
      pk AS (SELECT DISTINCT round_even(j * ((n - 1) / 49e0), 0)::BIGINT AS i FROM (SELECT unnest(range(0, 50)) AS j), (SELECT max(n) AS n FROM rk))
      SELECT sga_id, round(ra, 6) AS ra FROM rk WHERE n <= 50 OR i IN (SELECT i FROM pk) ORDER BY rk.ra, sga_id LIMIT 40""",
    "distinct_bricks": f"WITH {TARGETS} SELECT DISTINCT brick, hemisphere FROM targets",
    "pick_groups": f"""WITH {TARGETS}, gr AS (SELECT DISTINCT group_name, group_ra FROM targets), rk AS (SELECT *, row_number() OVER (ORDER BY group_ra, group_name) - 1 AS i, count(*) OVER () AS n FROM gr),
      pk AS (SELECT DISTINCT round_even(j * ((n - 1) / 29e0), 0)::BIGINT AS i FROM (SELECT unnest(range(0, 30)) AS j), (SELECT max(n) AS n FROM rk)) SELECT group_name, round(group_ra, 6) AS group_ra FROM rk WHERE n <= 30 OR i IN (SELECT i FROM pk)""",
    "catalogue_urls": "SELECT 'atlas.fits' AS name, 'https://portal.example/atlas.fits' AS url UNION ALL SELECT DISTINCT 'survey-bricks-dr-' || hemisphere || '.fits.gz', 'https://portal.example/' || hemisphere || '/survey-bricks-dr-' || hemisphere || '.fits.gz' FROM v_bricks",
    "checksum_urls": f"WITH {FILES} SELECT brick, hemisphere, 'https://portal.example/coadd/' || hemisphere || '/coadd/' || brick[1:3] || '/' || brick || '/survey_dr_' || hemisphere || '_coadd_' || brick[1:3] || '_' || brick || '.sha256sum' AS url FROM bh",
    "psf_present": "SELECT group_name, band FROM (SELECT DISTINCT group_name FROM v_galaxies), (SELECT unnest(['g', 'r', 'z']) AS band) WHERE (length(group_name) * 31 + ascii(right(group_name, 1)) + ascii(band)) % 5 <> 2",
    "seeded_sample": "SELECT sga_id, round(ra, 6) AS ra, round(dec, 6) AS dec FROM (SELECT * FROM v_galaxies ORDER BY md5(sga_id || ':7'), sga_id LIMIT 50)",
    "rejected_mirrored": f"WITH {FUNNEL} SELECT parent_sga_id, k, brick, reason FROM (SELECT * FROM outcome WHERE status = 'rejected' AND reason NOT IN ('footprint', 'fetch') AND brick IN (SELECT brickname FROM v_bricks WHERE nexp_g % 3 <> 1) ORDER BY parent_sga_id, k LIMIT 48)",
    "checksum_answers": "SELECT name, digest FROM (SELECT *, length(coalesce(digest, 'missing')) + 3 + length(name) AS n FROM v_checksums) WHERE digest IS NOT NULL AND n % 5 <> 0 AND n % 3 <> 0",
    "brick_urls": f"WITH {FILES} SELECT brick, kind, name, url FROM files",
    "psf_urls": "WITH g AS (SELECT DISTINCT group_name, group_ra FROM v_galaxies), b AS (SELECT unnest(['g', 'r', 'z']) AS band) SELECT group_name, band, 'https://portal.example/psf/' || lpad(trunc(group_ra)::INT::VARCHAR, 3, '0') || '/' || group_name || '/' || group_name || '-largegalaxy-psf-' || band || '.fits.fz' AS url FROM g, b",
    "propose_geometry": f"WITH {CAND} SELECT parent_sga_id, k, round(ra, 6) AS ra, round(dec, 6) AS dec, round(pa_deg, 6) AS pa_deg, round(sep_arcsec, 6) AS sep_arcsec, size_px FROM cand",
    "candidate_funnel": f"WITH {FUNNEL} SELECT parent_sga_id, k, brick, hemisphere, in_parent_brick, CASE WHEN reason = '' THEN 'candidate' ELSE 'rejected' END AS status, reason FROM tested",
    "candidate_outcome": f"WITH {FUNNEL} SELECT parent_sga_id, k, status, reason FROM outcome",
    "candidates_public": f"WITH {FUNNEL} SELECT parent_sga_id, k, round(ra, 6) AS ra, round(dec, 6) AS dec, round(pa_deg, 6) AS pa_deg, round(sep_arcsec, 6) AS sep_arcsec, size_px, brick, hemisphere, in_parent_brick, status, reason FROM outcome",
    "funnel_counts": f"""WITH {FUNNEL} SELECT count(*) AS proposed, count(*) FILTER (WHERE reason NOT IN ('footprint')) AS after_footprint, count(*) FILTER (WHERE reason NOT IN ('footprint', 'sga_overlap')) AS after_sga_overlap,
      count(*) FILTER (WHERE reason NOT IN ('footprint', 'sga_overlap', 'fetch')) AS after_fetch, count(*) FILTER (WHERE reason NOT IN ('footprint', 'sga_overlap', 'fetch', 'coverage')) AS after_coverage, count(*) FILTER (WHERE reason = '') AS after_sga_maskbit FROM tested""",
    "rejection_histogram": f"WITH {FUNNEL} SELECT reason, count(*) AS n FROM outcome WHERE status = 'rejected' GROUP BY 1",
    "survival": f"WITH {FUNNEL} SELECT count(*) AS n, round(avg((status = 'accepted')::INT), 6) AS survival, round(avg(in_parent_brick) FILTER (WHERE status = 'accepted'), 6) AS in_parent_brick FROM outcome",
    "separation_stats": f"WITH {FUNNEL} SELECT round(quantile_cont(sep_arcsec, 0.5), 4) AS sep_median, round(quantile_cont(sep_arcsec, 0.9), 4) AS sep_p90 FROM outcome WHERE status = 'accepted'",
    "brick_survival": f"WITH {FUNNEL}, e AS (SELECT brick, avg((status = 'accepted')::INT) AS s FROM outcome GROUP BY 1) SELECT count(*) AS n_bricks, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.75), 6) AS q75 FROM e",
    "accepted_per_galaxy": f"WITH {FUNNEL}, e AS (SELECT sga_id, count(o.k) AS n FROM targets LEFT JOIN (SELECT * FROM outcome WHERE status = 'accepted') o ON o.parent_sga_id = sga_id GROUP BY 1) SELECT round(avg(n), 6) AS mean_accepted, round(avg((n = 0)::INT), 6) AS none FROM e",
    "companion_ratio": f"WITH {COMPANIONS} SELECT sga_id, round(companion_ratio, 6) AS companion_ratio, round(companion_sep_r26, 6) AS companion_sep_r26 FROM comp",
    "companion_thresholds": f"WITH {COMPANIONS}, f AS (SELECT companion_ratio AS c FROM comp WHERE isfinite(companion_ratio)), t AS (SELECT unnest([1e-1, 2e-1, 5e-1]) AS threshold) SELECT threshold, count(*) FILTER (WHERE c > threshold) AS n, round(avg((c > threshold)::INT), 6) AS share FROM f, t GROUP BY 1",
    "layer_invalid": "SELECT sample_id, count(*) FILTER (WHERE NOT (ivar_g > 0 AND ivar_r > 0 AND ivar_z > 0)) AS n FROM v_pixels GROUP BY 1",
    "layer_bright": "SELECT sample_id, count(*) FILTER (WHERE (mask & 252) <> 0) AS n, count(*) FILTER (WHERE (mask & 4096) <> 0) AS n_galaxy_bit FROM v_pixels GROUP BY 1",
    "layer_source": f"WITH {FRAMES}, {PAINT_S} SELECT sample_id, count(*) AS n, sum(y * 8 + x)::BIGINT AS places FROM ps GROUP BY 1",
    "layer_galaxy": f"WITH {FRAMES}, {PAINT_G} SELECT sample_id, count(*) AS n, sum(y * 8 + x)::BIGINT AS places FROM pg GROUP BY 1",
    "layers_packed": f"WITH {PACKED} SELECT sample_id, layers, count(*) AS n FROM packed GROUP BY 1, 2",
    "layer_verdict": f"WITH {VERDICT} SELECT sample_id, round(valid_frac, 6) AS valid_frac, round(bright_frac, 6) AS bright_frac, round(source_frac, 6) AS source_frac, round(galaxy_frac, 6) AS galaxy_frac, round(galaxy_bit_frac, 6) AS galaxy_bit_frac FROM verdict",
    "coverage_verdict": "WITH f AS (SELECT sample_id, avg((ivar_g > 0 AND ivar_r > 0 AND ivar_z > 0)::INT) AS v FROM v_pixels GROUP BY 1) SELECT sample_id, round(v, 6) AS valid_frac, CASE WHEN v < 0.8e0 THEN 'rejected' ELSE 'written' END AS status, CASE WHEN v < 0.8e0 THEN 'coverage' ELSE '' END AS reason FROM f",
    "scan_images": """WITH m AS (SELECT concat('t', sample_id // 16) AS brick, (sample_id % 16) // 4 * 8 + y AS ty, sample_id % 4 * 8 + x AS tx, mask FROM v_pixels),
      t AS (SELECT DISTINCT brick FROM m) SELECT brick, 16::BIGINT AS n_rows, coalesce(sum(mask) FILTER (WHERE ty BETWEEN 8 AND 23), 0)::BIGINT AS mask_sum, coalesce(sum(mask * (ty * 32 + tx)) FILTER (WHERE ty BETWEEN 8 AND 23), 0)::BIGINT AS places FROM t JOIN m USING (brick) GROUP BY 1""",
    "tile_cutouts": f"""WITH m AS (SELECT sample_id // 16 AS tile, (sample_id % 16) // 4 * 8 + y AS ty, sample_id % 4 * 8 + x AS tx, * FROM v_pixels),
      s AS (SELECT DISTINCT sample_id AS id, sample_id // 16 AS tile, sample_id % 4 * 8 + sample_id % 9 + 0.3e0 AS cx, (sample_id % 16) // 4 * 8 + sample_id % 7 + 0.3e0 AS cy, (sample_id % 5 + 4)::INT AS size FROM v_pixels),
      g AS (SELECT *, unnest(range(0, size)) AS rw FROM s), h AS (SELECT *, unnest(range(0, size)) AS cl FROM g),
      j AS (SELECT h.*, m.tx, m.sci_r, CASE WHEN h.x BETWEEN 0 AND 31 AND h.y BETWEEN 0 AND 31 THEN coalesce(m.mask, 0) ELSE 1 END AS mask, m.ivar_g, m.ivar_r, m.ivar_z
        FROM (SELECT *, ceil(cx - size / 2e0)::INT + cl AS x, ceil(cy - size / 2e0)::INT + rw AS y FROM h) h LEFT JOIN m ON m.tile = h.tile AND m.tx = h.x AND m.ty = h.y),
      a AS (SELECT id, count(*) AS n, round(sum(coalesce(sci_r, 0e0)), 6) AS sci_r, round(sum(coalesce(ivar_z, 0e0) * (rw * size + cl)), 5) AS ivar_z, sum(mask)::BIGINT AS mask, round(avg(coalesce(ivar_g > 0 AND ivar_r > 0 AND ivar_z > 0, false)::INT), 6) AS valid_frac FROM j GROUP BY 1),
      q AS (SELECT id, least(greatest(round_even(cx, 0), 0), 31) AS col, least(greatest(round_even(cy, 0), 0), 31) AS row_, size // 2 AS half, tile FROM s),
      w AS (SELECT id, {", ".join(f"max(greatest(sci_{b}, 0e0)) FILTER (WHERE tx = col AND ty = row_) AS c_{b}, quantile_cont(sci_{b}, 0.5) FILTER (WHERE sci_{b} > 0) AS m_{b}" for b in "grz")} FROM q JOIN m ON m.tile = q.tile AND abs(tx - col) <= half AND abs(ty - row_) <= half GROUP BY 1)
      SELECT a.*, {", ".join(f"round(CASE WHEN c_{b} > 0 THEN c_{b} ELSE coalesce(m_{b}, 0e0) END, 6) AS psf_{b}" for b in "grz")} FROM a LEFT JOIN w USING (id)""",
    "sample_files": f"WITH {VERDICT}, s AS (SELECT sample_id, round(sum(CAST(sci_r AS FLOAT)::DOUBLE), 4) AS sci_r FROM v_pixels GROUP BY 1) SELECT sample_id, round(valid_frac, 6) AS valid_frac, round(bright_frac, 6) AS bright_frac, round(source_frac, 6) AS source_frac, round(galaxy_frac, 6) AS galaxy_frac, round(galaxy_bit_frac, 6) AS galaxy_bit_frac, sci_r FROM verdict JOIN s USING (sample_id)",
    "cutout_partial": """WITH c AS (SELECT DISTINCT sample_id, ceil((sample_id % 9)::DOUBLE - 3)::INT AS x_lo, ceil((sample_id % 7) + 0.25e0 - 3)::INT AS y_lo FROM v_pixels),
      g AS (SELECT *, unnest(range(0, 6)) AS rw FROM c), h AS (SELECT *, unnest(range(0, 6)) AS cl FROM g)
      SELECT h.sample_id, count(*) AS n, round(sum(coalesce(sci_r, 0e0)), 6) AS sci_r, round(sum(coalesce(ivar_z, 0e0) * (rw * 6 + cl)), 5) AS ivar_z, sum(coalesce(mask, 1))::BIGINT AS mask
      FROM h LEFT JOIN v_pixels p ON p.sample_id = h.sample_id AND p.x = x_lo + cl AND p.y = y_lo + rw GROUP BY 1""",
    "psf_fwhm": "WITH q AS (SELECT *, least(round_even((sample_id % 17) / 2e0, 0), 7) AS col, least(round_even((sample_id % 15) / 2e0, 0), 7) AS rw, (sample_id % 5 + 2) // 2 AS half FROM v_pixels), a AS (SELECT sample_id, "
    + ", ".join(f"max(greatest(sci_{b}, 0e0)) FILTER (WHERE x = col AND y = rw) AS c_{b}, quantile_cont(sci_{b}, 0.5) FILTER (WHERE abs(x - col) <= half AND abs(y - rw) <= half AND sci_{b} > 0) AS m_{b}" for b in "grz")
    + " FROM q GROUP BY 1) SELECT sample_id, " + ", ".join(f"round(CASE WHEN c_{b} > 0 THEN c_{b} ELSE coalesce(m_{b}, 0e0) END, 6) AS psf_{b}" for b in "grz") + " FROM a",
    "pull_stats": f"WITH {PACKED} SELECT count(*) AS n, round(avg(sci_r * sqrt(ivar_r)), 6) AS pull_mean, round(stddev_pop(sci_r * sqrt(ivar_r)), 6) AS pull_std, round(avg((sci_r < 0)::INT), 6) AS negative FROM packed WHERE layers = 0",
    "mad_sigma": """WITH m AS (SELECT *, quantile_cont(sci_r, 0.5) OVER (PARTITION BY sample_id) AS m FROM v_pixels), s AS (SELECT sample_id, 1.4826e0 * quantile_cont(abs(sci_r - m), 0.5) AS s FROM m GROUP BY 1), t AS (SELECT sample_id, CASE WHEN s = 0 THEN 1e-3 ELSE s END AS sigma FROM s)
      SELECT sample_id, round(sigma, 6) AS sigma, round(asinh(1 / (sigma * 3)), 6) AS stretch FROM t""",
    "extreme_samples": f"""WITH {VERDICT}, f AS (SELECT sample_id, round(galaxy_frac, 6) AS f FROM verdict) SELECT (SELECT sample_id FROM f ORDER BY f DESC, sample_id LIMIT 1) AS most, (SELECT max(f) FROM f) AS most_frac, (SELECT sample_id FROM f ORDER BY f, sample_id LIMIT 1) AS least, (SELECT min(f) FROM f) AS least_frac""",
    "seeing_spread": "WITH r AS (SELECT 'g' AS band, psf_g AS f, status FROM v_ledger UNION ALL SELECT 'r', psf_r, status FROM v_ledger UNION ALL SELECT 'z', psf_z, status FROM v_ledger) SELECT band, round(quantile_cont(f, 0.5), 6) AS median, round(quantile_cont(f, 0.05), 6) AS p05, round(quantile_cont(f, 0.95), 6) AS p95 FROM r WHERE status = 'written' GROUP BY 1",
    "frac_histogram": """WITH r AS (SELECT 'bright' AS class, bright_frac AS f FROM v_ledger UNION ALL SELECT 'source', source_frac FROM v_ledger UNION ALL SELECT 'galaxy', galaxy_frac FROM v_ledger),
      b AS (SELECT class, least(floor(f / 0.05e0), 19)::BIGINT AS bin, count(*) AS n FROM r WHERE f >= 0 AND f <= 1 GROUP BY 1, 2) SELECT class, bin, n, round(n / ((sum(n) OVER (PARTITION BY class)) * 0.05e0), 6) AS density FROM b""",
    "galaxy_bit_share": "SELECT status, round(avg((galaxy_bit_frac > 0)::INT), 6) AS share FROM v_ledger GROUP BY 1",
    "psf_normalise": f"WITH {STAMPS} SELECT sample_id, band, round(sum(value), 6) AS total, round(max(value), 6) AS peak FROM stamps GROUP BY 1, 2",
    "moffat_kernel": f"""WITH k AS (SELECT sample_id, {_MOFFAT} AS q, 2e0 * {_ALPHA.format(f=_FW, b=_BE)} * sqrt(power(2e0, 1e0 / {_BE}) - 1e0) AS w FROM v_pixels), n AS (SELECT sample_id, w, q / sum(q) OVER (PARTITION BY sample_id) AS q FROM k)
      SELECT sample_id, round(max(q), 9) AS peak, round(min(q), 9) AS edge, round(max(w), 6) AS fwhm FROM n GROUP BY 1""",
    "total_variation": f"WITH {STAMPS}, {_tv(_GAUSS, 'g')} SELECT sample_id, band, round(tv, 6) AS total_variation FROM g",
    "psf_library": f"WITH {PROFILES} SELECT sample_id, band, round(xa, 4) AS x0, round(ya, 4) AS y0, round(a, 4) AS alpha, round(b, 4) AS beta, round(fwhm, 4) AS fwhm_px FROM prof",
    "psf_summary": f"""WITH {PROFILES}, med AS (SELECT band, quantile_cont(b, 0.5) AS bb FROM prof GROUP BY 1),
      px AS (SELECT p.*, bb, y * 15 + x AS at, (x - xa) * (x - xa) + (y - ya) * (y - ya) AS r2 FROM prof p JOIN med USING (band), (SELECT unnest(range(0, 15)) AS x) xx, (SELECT unnest(range(0, 15)) AS y) yy),
      kn AS (SELECT sample_id, band, power(1 + r2 / (a * a), -b) AS v, power(1 + r2 / power(fwhm / (2e0 * sqrt(power(2e0, 1e0 / bb) - 1e0)), 2), -bb) AS m, exp(-0.5e0 * r2 / power(fwhm / 2.3548e0, 2)) AS g FROM px),
      su AS (SELECT *, sum(v) OVER w AS sv, sum(m) OVER w AS sm, sum(g) OVER w AS sg FROM kn WINDOW w AS (PARTITION BY sample_id, band)),
      tv AS (SELECT sample_id, band, 0.5e0 * sum(abs(v / sv - m / sm)) AS tm, 0.5e0 * sum(abs(v / sv - g / sg)) AS tg FROM su GROUP BY 1, 2)
      SELECT band, count(*) AS n_stamps, round(quantile_cont(b, 0.5), 5) AS beta_median, round(quantile_cont(b, 0.25), 5) AS beta_q25, round(quantile_cont(b, 0.75), 5) AS beta_q75, round(quantile_cont(fwhm, 0.5) * 0.262e0, 5) AS fwhm_median_arcsec,
      round(quantile_cont(tm, 0.5), 5) AS tv_moffat_median, round(quantile_cont(tm, 0.9), 5) AS tv_moffat_p90, round(quantile_cont(tg, 0.5), 5) AS tv_gauss_median, round(quantile_cont(tg, 0.9), 5) AS tv_gauss_p90 FROM tv JOIN prof USING (sample_id, band) GROUP BY 1""",
    "bright_stars": f"SELECT source_id, round(ra, 6) AS ra, round(dec, 6) AS dec, round(phot_g_mean_mag, 9) AS phot_g_mean_mag, round(b, 6) AS b FROM ({BRIGHT})",
    "bright_top10": f"SELECT source_id, round(ra, 6) AS ra, round(dec, 6) AS dec, round(m, 9) AS phot_g_mean_mag, round(b, 6) AS b FROM (SELECT *, phot_g_mean_mag AS m FROM ({BRIGHT}) ORDER BY m, source_id LIMIT 10)",
    "bright_star_summary": f"SELECT count(*) AS n, round(min(phot_g_mean_mag), 9) AS mag_min, round(max(phot_g_mean_mag), 9) AS mag_max, round(min(abs(b)), 6) AS b_min, round(max(abs(b)), 6) AS b_max FROM ({BRIGHT})",
    "star_sidecars": f"""WITH f AS (SELECT sga_id, ra, dec, d26 * 9e1 AS a FROM v_galaxies), j AS (SELECT f.sga_id, f.ra AS ra0, f.dec AS dec0, a, s.*, {_sep('f.', 's.')} AS sep FROM f JOIN v_stars s ON abs(f.dec - s.dec) < 0.1e0 AND s.phot_g_mean_mag < 15),
      p AS (SELECT *, round_even(a / 0.262e0, 0) AS n, round_even(a / 0.262e0, 0) / 2 - (ra - ra0) * cos({R}(dec0)) * 36e2 / 0.262e0 AS xp, round_even(a / 0.262e0, 0) / 2 + (dec - dec0) * 36e2 / 0.262e0 AS yp FROM j WHERE sep <= 0.5e0 * sqrt(2e0) * a)
      SELECT sga_id, source_id, round(ra, 6) AS ra_deg, round(dec, 6) AS dec_deg, round(phot_g_mean_mag, 9) AS gmag, round(sep, 6) AS sep_arcsec, round(sep / 0.262e0, 6) AS sep_pix, round(xp, 4) AS x_pix, round(yp, 4) AS y_pix FROM p WHERE xp >= 0 AND xp < n AND yp >= 0 AND yp < n""",
    "legacy_sizes": "SELECT sga_id, trunc(d26 * 3e0 * 3e1 / 0.262e0)::INT AS galaxy_px, least(512, greatest(16, round_even(d26 * 3e0 * 3e1 / 0.262e0, 0)))::INT AS field_px, round(d26 * 3e0 * 3e1, 6) AS size_arcsec FROM v_galaxies",
    "legacy_fields": f"""WITH a AS (SELECT *, d26 * 5e0 * 3e1 / 36e2 AS rad, unnest(range(0, 6)) AS i FROM v_galaxies) SELECT sga_id, round(i * 60e0, 6) AS angle_deg, round(ra + rad / cos({R}(dec)) * cos(2 * pi() * i / 6), 6) AS field_ra, round(least(90e0, greatest(-90e0, dec + rad * sin(2 * pi() * i / 6))), 6) AS field_dec FROM a""",
    "legacy_footprint": f"""WITH d AS (SELECT g.sga_id, g.ra, g.dec, b.* EXCLUDE (ra, dec), row_number() OVER (PARTITION BY g.sga_id, hemisphere ORDER BY round({_chord('g.', 'b.')}, 12), brickname) AS rk FROM v_galaxies g JOIN v_bricks b ON true)
      SELECT DISTINCT sga_id FROM d WHERE rk = 1 AND dec BETWEEN dec1 AND dec2 AND {_mod('ra - ra1')} <= {_mod('ra2 - ra1')} AND nexp_g + nexp_r + nexp_z >= 1""",
    "legacy_missing_counts": f"""WITH l AS (SELECT sga_id, arg_max(length, name) AS length FROM {_LISTED} GROUP BY 1), g AS (SELECT sga_id FROM v_galaxies WHERE z_leda > 0 AND z_leda < 5e-2)
      SELECT count(*) AS n_galaxies, (SELECT count(*) FROM l) AS n_files, count(*) FILTER (length IS NULL) AS n_missing, count(*) FILTER (length < 500) AS n_broken, count(*) FILTER (length IS NULL OR length < 500) AS n_retry FROM g LEFT JOIN l USING (sga_id)""",
    "legacy_missing": f"""WITH l AS (SELECT sga_id, arg_max(length, name) AS length FROM {_LISTED} GROUP BY 1), j AS (SELECT g.sga_id, g.ra, g.dec, g.d26, l.length FROM v_galaxies g LEFT JOIN l USING (sga_id) WHERE z_leda > 0 AND z_leda < 5e-2)
      SELECT sga_id, round(ra, 6) AS ra, round(dec, 6) AS dec, round(d26, 6) AS d26, coalesce(length, -1) AS length, CASE WHEN length IS NULL THEN 'missing' ELSE 'broken' END AS state FROM j WHERE length IS NULL OR length < 500""",
    "listing_parse": f"SELECT name, length, sga_id, round(ra, 6) AS ra, round(dec, 6) AS dec, round(size_arcsec, 6) AS size_arcsec FROM {_LISTED}",
    "manifest_written": "SELECT file, sga_id, round(ra, 6) AS ra, round(dec, 6) AS dec FROM v_ledger WHERE status = 'written'",
    "resume_galaxies": f"WITH {TARGETS} SELECT sga_id, brick, 'sga_' || sga_id || '.fits' AS file FROM targets WHERE 'sga_' || sga_id || '.fits' NOT IN (SELECT file FROM v_ledger)",
    "resume_backgrounds": f"WITH {TARGETS} SELECT t.sga_id, CASE WHEN l.file IS NULL THEN 'candidate' WHEN l.status = 'written' THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN l.status = 'rejected' THEN coalesce(l.reason, '') ELSE '' END AS reason FROM targets t LEFT JOIN v_ledger l ON l.file = 'sga_' || t.sga_id || '.fits'",
    "checksum_manifest": "SELECT name, digest FROM v_checksums WHERE digest IS NOT NULL",
    "checksum_lookup": "SELECT name, digest FROM v_checksums",
    "sha256_validate": "SELECT name, CASE WHEN digest IS NULL THEN 'unlisted' WHEN digest = sha256(content) THEN 'ok' ELSE 'bad' END AS state FROM v_checksums",
    "pending_bricks": f"WITH {FILES} SELECT DISTINCT brick FROM files WHERE failed",
    "fetch_summary": f"WITH {FILES} SELECT count(*) AS n_tasks, (sum(length(url) * 1000) FILTER (WHERE NOT failed))::BIGINT AS bytes, count(*) FILTER (WHERE failed) AS n_failed FROM files",
    "volume_report": f"WITH {TARGETS} SELECT (SELECT count(*) FROM v_ledger WHERE status = 'written') AS n_samples, (SELECT sum(bytes)::BIGINT FROM v_ledger WHERE status = 'written') AS sample_bytes, count(*) AS n_targets, count(DISTINCT brick) AS n_bricks, round((SELECT sum(bytes) / count(*) FROM v_ledger WHERE status = 'written') * count(*), 2) AS extrapolated_bytes FROM targets",
}
ORACLES = {name: with_views(sql) for name, sql in _SQL.items()}
