"""ANSI SQL (DuckDB dialect) for the registered queries.

Written from the operator contracts with other means than the Spark plans:
windows instead of tiles, grids joined to content instead of generated fill,
unrolled median-cut rounds instead of array batches.
"""

from __future__ import annotations

PIXEL = "image_id, width, height, x, y, r, g, b, a"


class Sql:
    """Named CTEs in order; ``text`` renders them with a final SELECT."""

    def __init__(self) -> None:
        self.ctes: list[tuple[str, str]] = []

    def add(self, name: str, body: str) -> str:
        if name not in [n for n, _ in self.ctes]:
            self.ctes.append((name, body))
        return name

    def text(self, final: str) -> str:
        ctes = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in self.ctes)
        return f"WITH {ctes}\n{final}"


def u8(v: str) -> str:
    return f"CAST(floor(least(greatest({v}, 0.0::DOUBLE), 255.0::DOUBLE) + 1e-9) AS INTEGER)"


def hash_byte(text: str, i: int) -> str:
    return f"CAST('0x' || substr(sha256({text}), {2 * i + 1}, 2) AS INTEGER)"


PARTS = "SELECT CAST(p_partkey AS VARCHAR) AS image_id, p_name AS prompt, p_partkey AS seed, p_size FROM part"


def glyphs(sql: Sql, name: str, source: str, w: int, h: int) -> str:
    """Pictures of ``source`` (image_id, prompt, seed)."""
    radius = min(w, h) * 0.36
    text = "coalesce(prompt, '') || ':' || CAST(seed AS VARCHAR)"
    sql.add(
        f"{name}_c",
        f"SELECT image_id, {hash_byte(text, 0)} AS pr, {hash_byte(text, 1)} AS pg, "
        f"{hash_byte(text, 2)} AS pb FROM ({source})",
    )
    d = f"(x - {w / 2.0}::DOUBLE) * (x - {w / 2.0}::DOUBLE) + (y - {h / 2.0}::DOUBLE) * (y - {h / 2.0}::DOUBLE)"
    grid = (
        f"SELECT image_id, pr, pg, pb, CAST(u.range AS INTEGER) AS x, CAST(v.range AS INTEGER) AS y "
        f"FROM {name}_c, range({w}) u, range({h}) v"
    )
    falloff = f"(dist / {max(1.0, radius)}::DOUBLE)"
    shade = f"least(greatest(1.0::DOUBLE - {falloff} * {falloff}, 0.0::DOUBLE), 1.0::DOUBLE)"
    tone = f"(0.4::DOUBLE + 0.6::DOUBLE * {shade})"
    inside = f"dist <= {radius}::DOUBLE"
    wave_r = f"18.0::DOUBLE + 6.0::DOUBLE * sin(x / {max(1.0, w)}::DOUBLE * 6.28::DOUBLE)"
    wave_b = f"26.0::DOUBLE + 6.0::DOUBLE * cos(y / {max(1.0, h)}::DOUBLE * 6.28::DOUBLE)"
    sql.add(
        name,
        f"SELECT image_id, {w} AS width, {h} AS height, x, y, "
        f"{u8(f'CASE WHEN {inside} THEN pr * {tone} ELSE {wave_r} END')} AS r, "
        f"{u8(f'CASE WHEN {inside} THEN pg * {tone} ELSE 20.0::DOUBLE END')} AS g, "
        f"{u8(f'CASE WHEN {inside} THEN pb * {tone} ELSE {wave_b} END')} AS b, "
        f"CASE WHEN {inside} THEN 255 ELSE 0 END AS a "
        f"FROM (SELECT *, sqrt({d}) AS dist FROM ({grid}))",
    )
    return name


def part_glyphs(sql: Sql, w: int = 16, h: int = 12, name: str = "glyph") -> str:
    return glyphs(sql, name, PARTS, w, h)


def gray(sql: Sql, gain: float = 1.0) -> str:
    return sql.add(
        "samples",
        "SELECT image_id, 8 AS width, 8 AS height, CAST(p % 8 AS INTEGER) AS x, "
        "CAST(p // 8 AS INTEGER) AS y, "
        f"(CAST(e AS DOUBLE) * {gain}::DOUBLE + 1.0::DOUBLE) * 127.5::DOUBLE AS v "
        "FROM (SELECT CAST(vec_id AS VARCHAR) AS image_id, unnest(embedding) AS e, "
        "generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)",
    )


def cutouts(sql: Sql) -> str:
    gray(sql)
    sql.add("gray8", f"SELECT image_id, width, height, x, y, {u8('v')} AS r FROM samples")
    return sql.add(
        "cutout",
        "SELECT image_id, width, height, x, y, r, 255 - r AS g, (x * 31 + y * 17) % 256 AS b, "
        "CASE WHEN r > 160 THEN 255 ELSE r % 100 END AS a FROM gray8",
    )


def box(sql: Sql, name: str, source: str, tw: str, th: str) -> str:
    """Area average: every target cell joined to the source pixels it covers."""
    for axis, size, target in (("x", "width", tw), ("y", "height", th)):
        sql.add(
            f"{name}_{axis}",
            f"SELECT DISTINCT s.size, s.target, o, p FROM "
            f"(SELECT DISTINCT {size} AS size, CAST({target} AS INTEGER) AS target FROM {source}) s, "
            f"LATERAL (SELECT unnest(range(s.target)) AS o), LATERAL (SELECT unnest(range(s.size)) AS p) "
            f"WHERE CASE WHEN s.target <= s.size THEN ((2*p+1)*s.target) // (2*s.size) = o "
            f"ELSE ((2*o+1)*s.size) // (2*s.target) = p END",
        )
    mean = lambda s, n: f"CASE WHEN {n} = 0 THEN 0 ELSE (2*{s}+{n}) // (2*{n}) END"
    return sql.add(
        name,
        "SELECT image_id, width, height, x, y, "
        f"CAST({mean('sr', 'sa')} AS INTEGER) AS r, CAST({mean('sg', 'sa')} AS INTEGER) AS g, "
        f"CAST({mean('sb', 'sa')} AS INTEGER) AS b, CAST({mean('sa', 'n')} AS INTEGER) AS a FROM ("
        "SELECT p.image_id, mx.target AS width, my.target AS height, CAST(mx.o AS INTEGER) AS x, "
        "CAST(my.o AS INTEGER) AS y, count(*) AS n, CAST(sum(a) AS BIGINT) AS sa, "
        "CAST(sum(r*a) AS BIGINT) AS sr, CAST(sum(g*a) AS BIGINT) AS sg, CAST(sum(b*a) AS BIGINT) AS sb "
        f"FROM {source} p JOIN {name}_x mx ON mx.p = p.x AND mx.size = p.width AND mx.target = {tw} "
        f"JOIN {name}_y my ON my.p = p.y AND my.size = p.height AND my.target = {th} "
        "GROUP BY p.image_id, mx.target, my.target, mx.o, my.o)",
    )


def median_cut(sql: Sql, name: str, source: str, colors: int) -> str:
    """Map (image_id, r, g, b) to (qr, qg, qb), one split per image and round."""
    sql.add(
        f"{name}_0",
        f"SELECT image_id, r, g, b, count(*) AS n, 0 AS box FROM {source} GROUP BY image_id, r, g, b",
    )
    for k in range(colors - 1):
        current = f"{name}_{k}"
        sql.add(
            f"{name}_p{k}",
            "SELECT image_id, box, tot, CASE WHEN dr >= dg AND dr >= db THEN 0 WHEN dg >= db THEN 1 "
            "ELSE 2 END AS axis FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY tot DESC, box) "
            "AS rn FROM (SELECT image_id, box, sum(n) AS tot, count(*) AS members, max(r)-min(r) AS dr, "
            f"max(g)-min(g) AS dg, max(b)-min(b) AS db FROM {current} GROUP BY image_id, box) "
            "WHERE members > 1) WHERE rn = 1",
        )
        sql.add(f"{name}_m{k}", f"SELECT image_id, max(box) + 1 AS boxes FROM {current} GROUP BY image_id")
        sql.add(
            f"{name}_v{k}",
            "SELECT *, coalesce(sum(n) OVER (PARTITION BY image_id, box ORDER BY v RANGE BETWEEN UNBOUNDED "
            "PRECEDING AND 1 PRECEDING), 0) AS below, max(v) OVER (PARTITION BY image_id, box) AS vmax FROM ("
            "SELECT c.*, m.boxes, p.tot, CASE p.axis WHEN 0 THEN c.r WHEN 1 THEN c.g WHEN 2 THEN c.b END AS v "
            f"FROM {current} c JOIN {name}_m{k} m USING (image_id) "
            f"LEFT JOIN {name}_p{k} p ON p.image_id = c.image_id AND p.box = c.box)",
        )
        sql.add(
            f"{name}_{k + 1}",
            "SELECT image_id, r, g, b, n, CASE WHEN v IS NOT NULL AND (2 * below >= tot OR v = vmax) "
            f"THEN boxes ELSE box END AS box FROM {name}_v{k}",
        )
    last = f"{name}_{colors - 1}"
    mean = lambda c: f"CAST((2*sum({c}*n)+sum(n)) // (2*sum(n)) AS INTEGER)"
    sql.add(
        f"{name}_b",
        f"SELECT image_id, box, {mean('r')} AS qr, {mean('g')} AS qg, {mean('b')} AS qb "
        f"FROM {last} GROUP BY image_id, box",
    )
    return sql.add(
        name,
        f"SELECT c.image_id, c.r, c.g, c.b, qr, qg, qb FROM {last} c JOIN {name}_b USING (image_id, box)",
    )


def quantized(sql: Sql, name: str, source: str, colors: int) -> str:
    cut = median_cut(sql, f"{name}_cut", source, colors)
    return sql.add(
        name,
        f"SELECT p.image_id, width, height, x, y, qr AS r, qg AS g, qb AS b, "
        f"CASE WHEN a >= 128 THEN 255 ELSE 0 END AS a FROM {source} p "
        f"JOIN {cut} q ON q.image_id = p.image_id AND q.r = p.r AND q.g = p.g AND q.b = p.b",
    )


def bounds(sql: Sql, name: str, source: str) -> str:
    return sql.add(
        name,
        "SELECT image_id, any_value(width) AS w, any_value(height) AS h, "
        "min(x) FILTER (a >= 128) AS x0, min(y) FILTER (a >= 128) AS y0, "
        "max(x) FILTER (a >= 128) + 1 AS x1, max(y) FILTER (a >= 128) + 1 AS y1 "
        f"FROM {source} GROUP BY image_id",
    )


def aligned(sql: Sql, name: str, source: str, w: int, h: int, anchor: str) -> str:
    """Canvas grid joined to the content rectangle of each image."""
    bounds(sql, f"{name}_bb", source)
    oy = f"{h} - (y1 - y0)" if anchor == "bottom_center" else f"CAST(floor(({h} - (y1 - y0)) / 2.0) AS INTEGER)"
    sql.add(
        f"{name}_at",
        f"SELECT image_id, x0, y0, x1, y1, CAST(floor(({w} - (x1 - x0)) / 2.0) AS INTEGER) AS ox, {oy} AS oy "
        "FROM (SELECT image_id, coalesce(x0, 0) AS x0, coalesce(y0, 0) AS y0, coalesce(x1, w) AS x1, "
        f"coalesce(y1, h) AS y1 FROM {name}_bb)",
    )
    return sql.add(
        name,
        f"SELECT g.image_id, {w} AS width, {h} AS height, g.x, g.y, coalesce(r, 0) AS r, coalesce(g_, 0) AS g, "
        "coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM "
        f"(SELECT image_id, CAST(u.range AS INTEGER) AS x, CAST(v.range AS INTEGER) AS y FROM {name}_at, "
        f"range({w}) u, range({h}) v) g LEFT JOIN "
        f"(SELECT p.image_id, p.x - x0 + ox AS x, p.y - y0 + oy AS y, r, g AS g_, b, a FROM {source} p "
        f"JOIN {name}_at t ON t.image_id = p.image_id WHERE p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1) c "
        "ON c.image_id = g.image_id AND c.x = g.x AND c.y = g.y",
    )


def normals(sql: Sql, name: str, source: str, strength: float = 2.0) -> str:
    """Sobel by windows along rows, then along columns."""
    sql.add(f"{name}_l", f"SELECT *, 299*r + 587*g + 114*b AS l FROM {source}")
    row = "OVER (PARTITION BY image_id, y ORDER BY x)"
    column = "OVER (PARTITION BY image_id, x ORDER BY y)"
    sql.add(
        f"{name}_h",
        f"SELECT *, coalesce(lag(l) {row}, l) - coalesce(lead(l) {row}, l) AS d, "
        f"coalesce(lag(l) {row}, l) + 2*l + coalesce(lead(l) {row}, l) AS s FROM {name}_l",
    )
    sql.add(
        f"{name}_g",
        f"SELECT *, coalesce(lag(d) {column}, d) + 2*d + coalesce(lead(d) {column}, d) AS gx, "
        f"coalesce(lag(s) {column}, s) - coalesce(lead(s) {column}, s) AS gy FROM {name}_h",
    )
    sql.add(
        f"{name}_n",
        f"SELECT *, sqrt(nx*nx + ny*ny + 1.0::DOUBLE) AS norm FROM (SELECT *, "
        f"-gx * {strength}::DOUBLE / 255000.0::DOUBLE AS nx, -gy * {strength}::DOUBLE / 255000.0::DOUBLE AS ny "
        f"FROM {name}_g)",
    )
    enc = lambda v, flat: f"CASE WHEN a >= 128 THEN {u8(f'({v} * 0.5::DOUBLE + 0.5::DOUBLE) * 255.0::DOUBLE')} ELSE {flat} END"
    return sql.add(
        name,
        f"SELECT {PIXEL}, {enc('nx / norm', 128)} AS nr, {enc('ny / norm', 128)} AS ng, "
        f"{enc('1.0::DOUBLE / norm', 255)} AS nb FROM {name}_n",
    )


def spritified(sql: Sql, name: str, source: str, w: int, h: int, gw: int, gh: int, colors: int) -> str:
    grid = box(sql, f"{name}_box", source, str(gw), str(gh))
    quant = quantized(sql, f"{name}_q", grid, colors)
    # Crop and align share the threshold; an image without content passes both whole.
    return normals(sql, name, aligned(sql, f"{name}_al", quant, w, h, "bottom_center"))


def requested(sql: Sql) -> str:
    """The three kinds of sprite requests, each with its own sizes."""
    kinds = (
        ("p_size <= 20", "seed", 24, (14, 12, 10, 10, 6)),
        ("p_size BETWEEN 21 AND 40", "seed", 20, (9, 12, 7, 10, 4)),
        ("p_size > 40 AND seed % 5 > 1", "7", 20, (14, 16, 10, 8, 6)),
    )
    made = []
    for i, (which, seed, render, sizes) in enumerate(kinds):
        source = f"SELECT image_id, prompt, {seed} AS seed FROM ({PARTS}) WHERE {which}"
        made.append(spritified(sql, f"sprite{i}", glyphs(sql, f"picture{i}", source, render, render), *sizes))
    return sql.add("requested", " UNION ALL ".join(f"SELECT {PIXEL}, nr, ng, nb FROM {m}" for m in made))


def digest(source: str, *values: str, key: str = "image_id", alias: str = "image_id") -> str:
    mixed = " + ".join(f"{v} * {(3, 7, 13, 29, 53, 97, 193)[i]}" for i, v in enumerate(values))
    return (
        f"SELECT {key} AS {alias}, count(*) AS pixels, CAST(sum(((x + 1) * 31 + (y + 1) * 1009) * "
        f"CAST({mixed} + 1 AS BIGINT)) AS BIGINT) AS checksum FROM {source} GROUP BY {key}"
    )


SIZED = (
    "SELECT CAST(p_partkey AS VARCHAR) AS image_id, p_name AS prompt, p_partkey AS seed, "
    "CASE WHEN p_size <= 40 THEN 4 ELSE 6 END AS width, CASE WHEN p_size <= 40 THEN 3 ELSE 5 END AS height FROM part"
)
FRAMES = (
    "SELECT CAST(l_orderkey AS VARCHAR) AS seq_id, l_linenumber * 1000000000::BIGINT + l_partkey AS frame_no, "
    "CAST(l_partkey AS VARCHAR) AS image_id FROM lineitem"
)


def sized_glyphs(sql: Sql) -> str:
    glyphs(sql, "small", f"{PARTS} WHERE p_size <= 40", 4, 3)
    glyphs(sql, "large", f"{PARTS} WHERE p_size > 40", 6, 5)
    return sql.add("sized", "SELECT * FROM small UNION ALL SELECT * FROM large")


def frame_facts(sql: Sql) -> None:
    sql.add("sizes", SIZED)
    sql.add("frames", FRAMES)
    sql.add(
        "facts",
        "SELECT seq_id, count(*) AS frames, min(width) AS fw, max(width) AS mw, min(height) AS fh, "
        "max(height) AS mh FROM frames JOIN sizes USING (image_id) GROUP BY seq_id",
    )


def strip(sql: Sql, source: str, extra: str = "") -> str:
    frame_facts(sql)
    return sql.add(
        "strip",
        f"SELECT f.seq_id AS image_id, t.frames * p.width AS width, p.height, pos * p.width + p.x AS x, p.y, "
        f"r, g, b, a {extra} FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY frame_no) - 1 AS pos "
        f"FROM frames) f JOIN facts t ON t.seq_id = f.seq_id AND t.fw = t.mw AND t.fh = t.mh "
        f"JOIN {source} p ON p.image_id = f.image_id",
    )


def pair_sides(sql: Sql) -> None:
    cutouts(sql)
    sql.add("lab", "SELECT CAST(vec_id AS VARCHAR) AS image_id, label FROM embeddings")
    sql.add(
        "side",
        f"SELECT {PIXEL} FROM cutout JOIN lab USING (image_id) WHERE label NOT IN (1, 2)",
    )
    normals(sql, "nside", "side")


STATUS_ROWS = """SELECT run_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, status,
CASE WHEN status = 'done' THEN 1.0::DOUBLE ELSE progress END AS progress, message,
CASE WHEN status = 'error' THEN message END AS error, status IN ('done', 'error') AS terminal
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn FROM runs) WHERE rn = 1"""

RUNS = """SELECT event_id, CAST(user_id AS VARCHAR) AS run_id, ts,
CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'running' END AS status,
least(1.0::DOUBLE, value / 500.0::DOUBLE) AS progress, 'RuntimeError: ' || props AS message FROM events"""

OUTCOMES = """SELECT run_id, outcome FROM (SELECT run_id, CASE WHEN end_ts <= submitted + INTERVAL 600 SECOND THEN end_status
WHEN coalesce(end_ts, now) >= submitted + INTERVAL 600 SECOND THEN 'timeout' END AS outcome
FROM (SELECT run_id, min(ts) AS submitted, min(ts) FILTER (status IN ('done', 'error')) AS end_ts,
arg_min(status, ts) FILTER (status IN ('done', 'error')) AS end_status, (SELECT max(ts) FROM runs) AS now
FROM runs GROUP BY run_id)) WHERE outcome IS NOT NULL"""

# Events by delivery; late is what lies an hour or more behind the newest event of earlier deliveries.
ARRIVALS = f"""SELECT r.*, ts > w IS NOT FALSE AS in_time FROM (
SELECT *, day(ts + to_seconds(event_id * 7919 % 7200)) // 8 AS delivery FROM ({RUNS})) r JOIN (
SELECT delivery, date_trunc('millisecond', max(max(ts)) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
- INTERVAL 1 HOUR AS w FROM (SELECT *, day(ts + to_seconds(event_id * 7919 % 7200)) // 8 AS delivery FROM ({RUNS})) GROUP BY delivery
) d USING (delivery)"""

STREAMED_OUTCOMES = """SELECT run_id, outcome FROM (SELECT run_id, CASE WHEN end_ts <= least(submitted + INTERVAL 600 SECOND, now) THEN end_status
WHEN submitted + INTERVAL 600 SECOND <= now AND coalesce(end_ts > submitted + INTERVAL 600 SECOND, true) THEN 'timeout' END AS outcome
FROM (SELECT run_id, min(ts) AS submitted, min(ts) FILTER (status IN ('done', 'error')) AS end_ts,
arg_min(status, ts) FILTER (status IN ('done', 'error')) AS end_status,
(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM runs) AS now
FROM runs WHERE in_time GROUP BY run_id)) WHERE outcome IS NOT NULL"""

REQUESTS = """SELECT CAST(event_id AS VARCHAR) AS request_id,
CASE WHEN event_type IN ('view', 'click') THEN 'text2img' WHEN event_type = 'purchase' THEN 'img2img'
WHEN event_type = 'signup' THEN 'text2vid' ELSE 'img2vid' END AS op,
'model-' || CAST(user_id % 4 AS VARCHAR) AS model_id, event_type || ' ' || props AS prompt, user_id AS seed FROM events"""

ROUTES = """SELECT * FROM (VALUES ('model-0', 'text2img', 'remote'), ('model-0', 'img2img', 'remote'),
('model-1', 'text2vid', 'remote'), ('model-2', 'text2img', 'local'), ('model-2', 'img2img', 'local'),
('model-2', 'img2vid', 'spare')) t(model_id, op, adapter)"""

PARAM_TEXTS = """SELECT event_id, CASE
WHEN event_type = 'view' THEN 'seed=' || user_id
WHEN event_type = 'click' THEN 'strength=' || value
WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN 'normal=TRUE'
WHEN event_type = 'purchase' THEN 'prompt=a=' || props
WHEN event_type = 'signup' AND user_id % 2 = 0 THEN 'seed= -' || user_id || ' '
WHEN event_type = 'signup' THEN 'scale=.' || user_id || 'e1'
WHEN user_id % 3 = 0 THEN '=' || user_id ELSE 'no value ' || user_id END AS text FROM events"""

MANIFEST = """SELECT CAST(l_orderkey AS VARCHAR) AS run_id, 0 AS pos,
concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
CASE l_returnflag WHEN 'R' THEN 'sprite_pair' WHEN 'A' THEN 'sprite_sheet' ELSE 'image' END AS kind,
CASE WHEN l_returnflag <> 'N' THEN 'd' || l_partkey END AS diffuse,
CASE WHEN l_returnflag = 'R' THEN 'n' || l_partkey END AS normal,
CASE WHEN l_returnflag = 'N' THEN 'i' || l_partkey END AS image,
CASE WHEN l_returnflag = 'A' THEN l_linenumber END AS frames,
CASE WHEN l_returnflag = 'A' THEN 4 END AS frame_w, CASE WHEN l_returnflag = 'A' THEN 3 END AS frame_h,
CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS meta_status FROM lineitem"""


def build() -> dict[str, str]:
    out: dict[str, str] = {}

    def rows(name: str, make, columns: str = PIXEL) -> None:
        sql = Sql()
        source = make(sql)
        out[name] = sql.text(f"SELECT {columns} FROM {source}")

    def final(name: str, prepare, select: str) -> None:
        sql = Sql()
        prepare(sql)
        out[name] = sql.text(select)

    # Sources and sinks
    rows("prompt_glyphs", part_glyphs)
    rows(
        "prompt_glyphs_from_text",
        lambda s: glyphs(s, "t", "SELECT CAST(doc_id AS VARCHAR) AS image_id, text AS prompt, 7 AS seed FROM documents", 5, 4),
    )
    rows("read_png_images", part_glyphs)
    out["png_image_table"] = f"SELECT image_id, width, height, 'image' AS kind FROM ({SIZED})"
    rows("decode_png_payloads", sized_glyphs)
    final(
        "decode_rgba_payloads",
        lambda s: s.add(
            "v",
            "SELECT image_id, p, CAST(floor(least(greatest((CAST(e AS DOUBLE) + 1.0::DOUBLE) * 127.5::DOUBLE, 0.0::DOUBLE), 255.0::DOUBLE)) AS INTEGER) AS v "
            "FROM (SELECT CAST(vec_id AS VARCHAR) AS image_id, unnest(embedding) AS e, "
            "generate_subscripts(embedding, 1) - 1 AS p FROM embeddings WHERE label % 2 = 0)",
        ),
        "SELECT image_id, 8 AS width, 2 AS height, CAST(p // 4 % 8 AS INTEGER) AS x, CAST(p // 32 AS INTEGER) AS y, "
        "max(v) FILTER (p % 4 = 0) AS r, max(v) FILTER (p % 4 = 1) AS g, max(v) FILTER (p % 4 = 2) AS b, "
        "max(v) FILTER (p % 4 = 3) AS a FROM v GROUP BY image_id, p // 4, p // 32",
    )
    out["decode_payload_rejects"] = (
        "SELECT CAST(vec_id AS VARCHAR) AS image_id, 'ValueError: unrecognized image payload' AS reason "
        "FROM embeddings WHERE label % 2 = 1"
    )
    kind6 = (
        "CASE seed % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'normal_map' WHEN 2 THEN 'sprite_pair' "
        "WHEN 3 THEN 'sprite_sheet' WHEN 4 THEN 'mask' ELSE 'palette' END"
    )

    def stored(s: Sql) -> None:
        normals(s, "shaded", sized_glyphs(s))
        s.add("kinds", f"SELECT image_id, {kind6} AS kind FROM ({PARTS})")
        s.add(
            "stored",
            "SELECT kind || '/' || CASE WHEN kind = 'image' THEN 'image' ELSE 'diffuse' END || '/' || image_id AS image_id, "
            "x, y, r, g, b, a FROM shaded JOIN kinds USING (image_id) WHERE kind IN ('image', 'sprite_pair', 'sprite_sheet') "
            "UNION ALL SELECT kind || '/' || CASE WHEN kind = 'normal_map' THEN 'image' ELSE 'normal' END || '/' || image_id, "
            "x, y, nr, ng, nb, 255 FROM shaded JOIN kinds USING (image_id) WHERE kind IN ('normal_map', 'sprite_pair', 'sprite_sheet')",
        )

    final("stored_artifact_pixels", stored, digest("stored", "r", "g", "b", "a"))
    out["stored_artifact_entries"] = (
        f"SELECT image_id, {kind6} AS kind, prompt FROM ({PARTS}) WHERE seed % 6 < 4"
    )
    out["stored_layer_files"] = (
        f"WITH k AS (SELECT image_id, {kind6} AS kind FROM ({PARTS})) "
        "SELECT image_id || '-image' AS file_id, false AS missing FROM k WHERE kind IN ('image', 'normal_map') UNION ALL "
        "SELECT image_id || '-diffuse', false FROM k WHERE kind IN ('sprite_pair', 'sprite_sheet') UNION ALL "
        "SELECT image_id || '-normal', false FROM k WHERE kind IN ('sprite_pair', 'sprite_sheet')"
    )
    out["unstorable_artifacts"] = (
        "SELECT kind, 'ValueError: the store takes no ' || kind AS reason, count(*) AS n FROM ("
        "SELECT CASE WHEN l_returnflag = 'N' THEN 'image_batch' WHEN l_linestatus = 'O' THEN 'frame_seq' ELSE 'image' END AS kind "
        "FROM lineitem) WHERE kind <> 'image' GROUP BY kind"
    )
    out["manifest_append"] = (
        "SELECT CAST(l_orderkey AS VARCHAR) AS run_id, 'single_sprite' AS task, count(*) AS runs, "
        "count(*) AS artifacts FROM lineitem GROUP BY l_orderkey"
    )
    url = lambda c: f"'/api/artifacts/' || {c}"
    out["manifest_result_rows"] = (
        f"SELECT run_id, pos, id, kind, {url('diffuse')} AS diffuse_url, {url('normal')} AS normal_url, "
        f"{url('image')} AS url, frames, frame_w, frame_h, meta_status, "
        f"CASE WHEN kind = 'sprite_pair' THEN 1 ELSE 0 END AS meta_entries FROM ({MANIFEST})"
    )
    out["missing_artifact_files"] = (
        f"WITH m AS ({MANIFEST}), f AS (SELECT 'd' || p_partkey AS file_id FROM part WHERE p_size > 10 "
        "UNION ALL SELECT 'i' || p_partkey FROM part WHERE p_size > 10 "
        "UNION ALL SELECT 'n' || p_partkey FROM part WHERE p_size > 30) "
        "SELECT file_id, run_id, id, role FROM (SELECT run_id, id, 'diffuse' AS role, diffuse AS file_id FROM m "
        "UNION ALL SELECT run_id, id, 'normal', normal FROM m UNION ALL SELECT run_id, id, 'image', image FROM m) "
        "WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM f)"
    )

    # Projections, filters, scalar functions
    v = u8("v")
    final("ensure_rgba_gray", lambda s: gray(s, 6.0),
          f"SELECT image_id, width, height, x, y, {v} AS r, {v} AS g, {v} AS b, 255 AS a FROM samples")
    color = f"{v} AS r, {u8('255.0::DOUBLE - v')} AS g, {u8('v * 0.5::DOUBLE')} AS b"
    final("ensure_rgba_color", lambda s: gray(s, 6.0),
          f"SELECT image_id, width, height, x, y, {color}, 255 AS a FROM samples")
    final("ensure_rgba_alpha", lambda s: gray(s, 6.0),
          f"SELECT image_id, width, height, x, y, {color}, {u8('v + 100.5::DOUBLE')} AS a FROM samples")
    final("hard_alpha", cutouts,
          "SELECT image_id, width, height, x, y, r, g, b, CASE WHEN r >= 128 THEN 255 ELSE 0 END AS a FROM cutout")
    final("content_mask", cutouts,
          "SELECT image_id, width, height, x, y, CASE WHEN a >= 128 THEN 255 ELSE 0 END AS m FROM cutout")
    final("content_pixels", part_glyphs, f"SELECT {PIXEL} FROM glyph WHERE a >= 128")
    final("luminance", part_glyphs,
          "SELECT image_id, x, y, (299*r + 587*g + 114*b) / 255000.0::DOUBLE AS luma FROM glyph")
    final(
        "nearest_resize", part_glyphs,
        "SELECT p.image_id, 11 AS width, 17 AS height, CAST(u.range AS INTEGER) AS x, CAST(v.range AS INTEGER) AS y, r, g, b, a "
        "FROM range(11) u, range(17) v, glyph p WHERE p.x = ((2*u.range+1)*16) // 22 AND p.y = ((2*v.range+1)*12) // 34",
    )
    final(
        "integer_upscale", cutouts,
        "SELECT image_id, width*3 AS width, height*3 AS height, CAST(x*3+u.range AS INTEGER) AS x, "
        "CAST(y*3+v.range AS INTEGER) AS y, r, g, b, a FROM cutout, range(3) u, range(3) v",
    )
    tint = lambda i: f"(0.5::DOUBLE + 0.5::DOUBLE * ({hash_byte(chr(112) + ' || ' + repr(':0'), i)} / 255.0::DOUBLE))"
    final(
        "prompt_retint", part_glyphs,
        f"SELECT image_id, width, height, x, y, {u8('r * t0')} AS r, {u8('g * t1')} AS g, {u8('b * t2')} AS b, a "
        f"FROM glyph JOIN (SELECT image_id, {tint(0)} AS t0, {tint(1)} AS t1, {tint(2)} AS t2 FROM "
        f"(SELECT CAST(p_partkey AS VARCHAR) AS image_id, CASE WHEN p_size > 5 THEN p_name ELSE '' END AS p FROM part)) "
        "USING (image_id)",
    )
    out["display_scales"] = (
        "SELECT image_id, CAST(greatest(1, floor(256 / longest)) AS INTEGER) AS display_scale, 48 / longest AS thumb_scale "
        "FROM (SELECT CAST(p_partkey AS VARCHAR) AS image_id, CAST(greatest(p_size * 7, p_partkey % 97 + 1) AS DOUBLE) AS longest FROM part)"
    )
    int_re, float_re = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    out["parsed_params"] = (
        f"SELECT event_id, text, name, CASE WHEN type = 'bool' THEN lower(value) ELSE value END AS value, type, "
        "CASE WHEN type = 'int' THEN CAST(trim(value) AS BIGINT) END AS int_value, "
        "CASE WHEN type = 'float' THEN CAST(trim(value) AS DOUBLE) END AS float_value FROM ("
        "SELECT *, CASE WHEN lower(value) IN ('true', 'false') THEN 'bool' "
        f"WHEN regexp_matches(value, '{int_re}') THEN 'int' WHEN regexp_matches(value, '{float_re}') THEN 'float' "
        "ELSE 'string' END AS type FROM (SELECT event_id, text, substr(text, 1, instr(text, '=') - 1) AS name, "
        f"substr(text, instr(text, '=') + 1) AS value FROM ({PARAM_TEXTS}) WHERE instr(text, '=') > 0))"
    )
    out["parsed_param_rejects"] = (
        f"SELECT event_id, text, 'ValueError: expected k=v, got ' || text AS reason FROM ({PARAM_TEXTS}) "
        "WHERE instr(text, '=') = 0"
    )

    # Aggregations
    def soft_box(s: Sql) -> str:
        part_glyphs(s)
        s.add("soft", "SELECT image_id, width, height, x, y, r, g, b, least(a, r + x) AS a FROM glyph")
        return box(s, "boxed", "soft", "7", "5")

    rows("box_downsample", soft_box)
    rows("box_resample_mixed", lambda s: box(s, "boxed", cutouts(s), "5", "11"))
    rows("pixelize", lambda s: quantized(s, "q", box(s, "boxed", part_glyphs(s), "8", "6"), 6))
    final(
        "pixelize_upscaled",
        lambda s: quantized(s, "q", box(s, "boxed", cutouts(s), "6", "5"), 4),
        "SELECT image_id, width*2 AS width, height*2 AS height, CAST(x*2+u.range AS INTEGER) AS x, "
        "CAST(y*2+v.range AS INTEGER) AS y, r, g, b, a FROM q, range(2) u, range(2) v",
    )
    final(
        "pixel_perfect",
        lambda s: box(s, "boxed", cutouts(s), "greatest(1, width // 3)", "greatest(1, height // 3)"),
        "SELECT image_id, width*3 AS width, height*3 AS height, CAST(x*3+u.range AS INTEGER) AS x, "
        "CAST(y*3+v.range AS INTEGER) AS y, r, g, b, CASE WHEN a >= 128 THEN 255 ELSE 0 END AS a "
        "FROM boxed, range(3) u, range(3) v",
    )
    final("alpha_bounds", lambda s: bounds(s, "bb", cutouts(s)), "SELECT image_id, x0, y0, x1, y1 FROM bb")
    rows("quantize", lambda s: quantized(s, "q", part_glyphs(s), 6))
    final(
        "image_palette",
        lambda s: quantized(s, "q", box(s, "boxed", part_glyphs(s), "8", "6"), 6),
        "SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b, a) - 1 AS INTEGER) AS palette_ix "
        "FROM (SELECT image_id, r, g, b, a, count(*) AS n FROM q GROUP BY ALL)",
    )
    final("image_color_counts", part_glyphs,
          "SELECT image_id, count(DISTINCT (r, g, b)) AS colors FROM glyph GROUP BY image_id")
    final(
        "image_integrity",
        lambda s: (
            part_glyphs(s, 6, 4),
            s.add(
                "broken",
                "SELECT image_id, width, height, CASE WHEN damage = 2 AND corner THEN 4 ELSE x END AS x, y, "
                "CASE WHEN damage = 3 AND corner THEN 300 ELSE r END AS r, g, b, a FROM ("
                "SELECT *, CAST(image_id AS BIGINT) % 5 AS damage, x = 5 AND y = 3 AS corner FROM glyph) "
                "WHERE NOT (damage = 1 AND corner)",
            ),
        ),
        "SELECT *, pixels = expected AND positions = expected AND misplaced = 0 AND bad_values = 0 AS ok FROM ("
        "SELECT image_id, count(*) AS pixels, count(DISTINCT (x, y)) AS positions, CAST(24 AS BIGINT) AS expected, "
        "count(*) FILTER (x < 0 OR x >= width OR y < 0 OR y >= height) AS misplaced, "
        "count(*) FILTER (r NOT BETWEEN 0 AND 255 OR g NOT BETWEEN 0 AND 255 OR b NOT BETWEEN 0 AND 255 OR a NOT BETWEEN 0 AND 255) AS bad_values "
        "FROM broken GROUP BY image_id)",
    )
    final("equal_frame_sequences", frame_facts,
          "SELECT seq_id, frames, fw AS frame_w, fh AS frame_h FROM facts WHERE fw = mw AND fh = mh")
    final("unequal_frame_rejects", frame_facts,
          "SELECT seq_id, frames, 'ValueError: frames differ in size' AS reason FROM facts WHERE fw <> mw OR fh <> mh")

    # Joins
    def cropped(padding: int):
        def make(s: Sql) -> str:
            bounds(s, "bb", cutouts(s))
            p = padding
            s.add(
                "grid",
                "SELECT image_id, x0, y0, cw, ch, CAST(unnest(range(cw)) AS INTEGER) AS x, h FROM ("
                f"SELECT image_id, x0, y0, h, CASE WHEN x0 IS NULL THEN w ELSE x1 - x0 + {2 * p} END AS cw, "
                f"CASE WHEN x0 IS NULL THEN h ELSE y1 - y0 + {2 * p} END AS ch FROM bb)",
            )
            s.add("cells", "SELECT *, CAST(unnest(range(ch)) AS INTEGER) AS y FROM grid")
            return s.add(
                "cropped",
                "SELECT c.image_id, cw AS width, ch AS height, c.x, c.y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, "
                "coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM cells c JOIN bb USING (image_id) LEFT JOIN cutout p "
                f"ON p.image_id = c.image_id AND p.x = CASE WHEN c.x0 IS NULL THEN c.x ELSE c.x - {p} + c.x0 END "
                f"AND p.y = CASE WHEN c.y0 IS NULL THEN c.y ELSE c.y - {p} + c.y0 END "
                "AND (c.x0 IS NULL OR (p.x >= bb.x0 AND p.x < bb.x1 AND p.y >= bb.y0 AND p.y < bb.y1))",
            )
        return make

    rows("crop_to_content", cropped(0))
    rows("crop_with_padding", cropped(2))
    final("crop_meta", lambda s: bounds(s, "bb", cutouts(s)),
          "SELECT image_id, CASE WHEN x0 IS NULL THEN 'no' ELSE 'true' END AS cropped FROM bb")
    rows("center_align_bottom", lambda s: aligned(s, "al", cutouts(s), 11, 9, "bottom_center"))
    rows("center_align_oversize", lambda s: aligned(s, "al", part_glyphs(s), 5, 4, "center"))
    final(
        "align_pivots",
        lambda s: aligned(s, "al", cutouts(s), 11, 9, "bottom_center"),
        "SELECT image_id, 11 AS width, 9 AS height, 'true' AS pixelized, '[8, 8]' AS grid, '32' AS colors, "
        "'bottom_center' AS anchor, '[11, 9]' AS canvas, "
        "'[' || CAST(ox + CAST(floor((x1 - x0) / 2.0) AS INTEGER) AS VARCHAR) || ', 8]' AS pivot_at FROM al_at",
    )
    final(
        "paste_on_canvas",
        lambda s: (cutouts(s), s.add("ids", "SELECT image_id, CAST(image_id AS INTEGER) % 23 - 11 AS ox, "
                                     "CAST(image_id AS INTEGER) % 7 - 3 AS oy FROM cutout GROUP BY image_id")),
        "SELECT i.image_id, 10 AS width, 9 AS height, CAST(u.range AS INTEGER) AS x, CAST(v.range AS INTEGER) AS y, "
        "coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a "
        "FROM ids i CROSS JOIN range(10) u CROSS JOIN range(9) v LEFT JOIN cutout p ON p.image_id = i.image_id "
        "AND p.x = u.range - ox AND p.y = v.range - oy",
    )
    final(
        "sprite_pairs", pair_sides,
        "SELECT c.image_id, c.width, c.height, c.x, c.y, c.r, c.g, c.b, c.a, n.nr, n.ng, n.nb, n.nr IS NOT NULL AS has_normal "
        "FROM cutout c JOIN lab ON lab.image_id = c.image_id AND label <> 1 "
        "LEFT JOIN nside n ON n.image_id = c.image_id AND n.x = c.x AND n.y = c.y",
    )
    out["sprite_pair_rejects"] = (
        "SELECT CAST(vec_id AS VARCHAR) AS image_id, 'ValueError: normal map must match diffuse size' AS reason "
        "FROM embeddings WHERE label = 1"
    )

    def lit(s: Sql) -> None:
        normals(s, "shaded", part_glyphs(s))
        d = "::DOUBLE"
        s.add(
            "lights",
            f"SELECT * FROM (VALUES ('default', 0.0{d}, 0.0{d}, 1.0{d}, 255/255.0{d}, 242/255.0{d}, 208/255.0{d}, 0.15{d}, 1.4{d}), "
            f"('left', -0.6{d}, 0.4{d}, 0.1{d}, 200/255.0{d}, 220/255.0{d}, 255/255.0{d}, 0.3{d}, 2.0{d})) "
            "t(light_id, lx, ly, lz, cr, cg, cb, ambient, intensity)",
        )
        s.add(
            "aimed",
            f"SELECT *, nx / nlen AS ux, ny / nlen AS uy, nz / nlen AS uz, sqrt(dx*dx + dy*dy + dz*dz) AS dist FROM ("
            f"SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS nlen, lx - ((x + 0.5{d}) / 16.0{d} - 0.5{d}) * 1.6{d} AS dx, "
            f"ly - (0.5{d} - (y + 0.5{d}) / 12.0{d}) * (1.6{d} / (16.0{d} / 12.0{d})) AS dy, lz AS dz FROM ("
            f"SELECT *, nr / 255.0{d} * 2.0{d} - 1.0{d} AS nx, ng / 255.0{d} * 2.0{d} - 1.0{d} AS ny, "
            f"nb / 255.0{d} * 2.0{d} - 1.0{d} AS nz FROM shaded, lights WHERE a / 255.0{d} >= 0.01{d}))",
        )
        s.add(
            "shade2",
            f"SELECT *, greatest(ux * (dx / greatest(dist, 0.0001{d})) + (uy * (dy / greatest(dist, 0.0001{d})) + "
            f"uz * (dz / greatest(dist, 0.0001{d}))), 0.0{d}) AS diff, 1.0{d} / (1.0{d} + 0.35{d} * dist * dist) AS atten FROM aimed",
        )

    lc = lambda c: (
        f"CAST(floor(least(greatest({c} / 255.0::DOUBLE * (ambient + c{c} * diff * intensity * atten), 0.0::DOUBLE), "
        f"1.0::DOUBLE) * 255.0::DOUBLE + 0.5::DOUBLE) AS INTEGER) AS l{c}"
    )
    final("relit_pairs", lit,
          f"SELECT image_id, light_id, width, height, x, y, {lc('r')}, {lc('g')}, {lc('b')}, a FROM shade2")
    out["routed_requests"] = (
        f"SELECT request_id, op, model_id, adapter FROM ({REQUESTS}) JOIN ({ROUTES}) USING (model_id, op)"
    )
    out["unroutable_requests"] = (
        "SELECT request_id, op, model_id, 'LookupError: no adapter serves op=''' || op || ''' model_id=''' || model_id || '''' AS reason "
        f"FROM ({REQUESTS}) LEFT JOIN ({ROUTES}) USING (model_id, op) WHERE adapter IS NULL"
    )
    out["layered_params"] = (
        "WITH e AS (SELECT CAST(event_id AS VARCHAR) AS request_id, event_type, user_id, props->>'$.k' AS k FROM events), "
        "d AS (SELECT * FROM (VALUES ('prompt', 'string', ''), ('model_id', 'string', 'stub-image'), ('seed', 'int', '0'), "
        "('width', 'int', '64'), ('height', 'int', '80'), ('grid_w', 'int', '64'), ('grid_h', 'int', '64'), "
        "('colors', 'int', '32')) t(name, type, fallback)), "
        "o AS (SELECT request_id, 'seed' AS name, CAST(user_id AS VARCHAR) AS given FROM e WHERE event_type = 'view' "
        "UNION ALL SELECT request_id, 'width', '48' FROM e WHERE event_type = 'click' "
        "UNION ALL SELECT request_id, 'prompt', NULL FROM e WHERE event_type = 'purchase') "
        "SELECT e.request_id, d.name, d.type, CASE WHEN o.request_id IS NOT NULL THEN o.given ELSE fallback END AS value "
        "FROM e CROSS JOIN d LEFT JOIN o ON o.request_id = e.request_id AND o.name = d.name WHERE e.event_type <> 'error' "
        "UNION ALL SELECT request_id, 'k', NULL, k FROM e WHERE k IS NOT NULL"
    )
    out["filled_templates"] = (
        "SELECT event_id, event_type AS prompt, (props->>'$.k') || '|fixed|a${k}' AS steps, CAST(user_id AS VARCHAR) AS seed, "
        "'${user} x' AS note FROM events WHERE event_type <> 'error'"
    )
    out["undefined_template_rejects"] = (
        "SELECT event_id, 'KeyError: undefined param missing' AS reason FROM events WHERE event_type = 'error'"
    )
    picks = "o_orderpriority <> '5-LOW'"
    out["chosen_candidates"] = (
        "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'gen' AS node_id, 'spritify' AS chosen FROM orders UNION ALL "
        f"SELECT CAST(o_orderkey AS VARCHAR), 'spr', CASE WHEN {picks} THEN 'variant_' || o_orderstatus ELSE 'spritify' END "
        f"FROM orders WHERE NOT ({picks} AND o_orderstatus NOT IN ('F', 'O'))"
    )
    out["candidate_rejects"] = (
        "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'spr' AS node_id, "
        "'KeyError: task node spr: ''variant_' || o_orderstatus || ''' is not a candidate' AS reason "
        f"FROM orders WHERE {picks} AND o_orderstatus NOT IN ('F', 'O')"
    )

    # Windows and ordered operators
    rows("normal_maps", lambda s: normals(s, "shaded", part_glyphs(s)), f"{PIXEL}, nr, ng, nb")
    rows("normal_maps_tiled", lambda s: normals(s, "shaded", cutouts(s), 0.7), "image_id, x, y, nr, ng, nb")
    out["ranked_frames"] = (
        "SELECT seq_id, frame_no, image_id, row_number() OVER (PARTITION BY seq_id ORDER BY frame_no) - 1 AS pos "
        f"FROM ({FRAMES})"
    )
    final("sheet_layouts", frame_facts,
          "SELECT seq_id AS sheet_id, frames, fw AS frame_w, fh AS frame_h, frames * fw AS width, fh AS height "
          "FROM facts WHERE fw = mw AND fh = mh")
    final("packed_sheets", lambda s: strip(s, sized_glyphs(s)),
          digest("strip", "r", "g", "b", "a", "width", "height"))
    final(
        "sliced_sheets", part_glyphs,
        "SELECT image_id AS sheet_id, CAST((y // 4) * 3 + x // 5 AS INTEGER) AS frame_no, 5 AS width, 4 AS height, "
        "CAST(x % 5 AS INTEGER) AS x, CAST(y % 4 AS INTEGER) AS y, r, g, b, a FROM glyph WHERE x < 15",
    )
    out["sheet_metas"] = (
        "SELECT CAST(o_orderkey AS VARCHAR) AS sheet_id, CAST(o_custkey % 30 AS VARCHAR) AS fps, 'true' AS packed FROM orders"
    )
    inner = "least(greatest(value / 400.0::DOUBLE - 0.05::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)"
    ix = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END"
    out["task_progress"] = (
        f"SELECT event_id, CASE WHEN event_type = 'signup' THEN 0 / 2::DOUBLE + (1.0::DOUBLE / 2) * (0 / 1::DOUBLE + (1.0::DOUBLE / 1) * {inner}) "
        f"ELSE 1 / 2::DOUBLE + (1.0::DOUBLE / 2) * ({ix} / 4::DOUBLE + (1.0::DOUBLE / 4) * {inner}) END AS progress FROM events"
    )
    out["unknown_node_rejects"] = (
        "SELECT event_id, 'LookupError: spr/lost is no node of the graph' AS reason FROM events WHERE event_type = 'error'"
    )
    out["latest_run_status"] = f"WITH runs AS ({RUNS}) {STATUS_ROWS}"
    out["primary_artifacts"] = (
        f"SELECT run_id, id, kind, '/api/artifacts/' || normal AS normal_url FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY run_id ORDER BY (normal IS NULL), id) AS rn FROM ({MANIFEST})) WHERE rn = 1"
    )
    out["first_outputs"] = (
        "SELECT concat_ws('-', conv_id, turn) AS request_id, string_split(text, ' ')[1] AS output "
        "FROM conversations WHERE role = 'user' AND text IS NOT NULL"
    )
    out["missing_output_rejects"] = (
        "SELECT concat_ws('-', conv_id, turn) AS request_id, 'ValueError: the result has no output' AS reason "
        "FROM conversations WHERE role <> 'user' OR role IS NULL OR text IS NULL"
    )

    # Set operations
    def versions(s: Sql) -> None:
        glyphs(s, "one", PARTS, 6, 5)
        changed = (
            "SELECT CAST(p_partkey AS VARCHAR) AS image_id, p_name AS prompt, "
            "CASE WHEN p_size > 40 THEN p_partkey + 1 ELSE p_partkey END AS seed FROM part"
        )
        glyphs(s, "two", changed, 6, 5)
        s.add(
            "delta",
            f"SELECT {PIXEL}, 1 AS delta FROM (SELECT * FROM one EXCEPT ALL SELECT * FROM two) UNION ALL "
            f"SELECT {PIXEL}, -1 FROM (SELECT * FROM two EXCEPT ALL SELECT * FROM one)",
        )

    final("image_differences", versions, f"SELECT {PIXEL}, CAST(delta AS BIGINT) AS delta FROM delta")
    final("differing_images", versions,
          "SELECT image_id, count(*) FILTER (delta > 0) AS only_left, count(*) FILTER (delta < 0) AS only_right "
          "FROM delta GROUP BY image_id")

    # Streaming
    out["streamed_run_status"] = out["latest_run_status"]
    out["job_timeouts"] = f"WITH runs AS ({RUNS}) {OUTCOMES}"
    out["streamed_job_timeouts"] = f"WITH runs AS ({ARRIVALS}) {STREAMED_OUTCOMES}"
    out["late_run_events"] = f"SELECT run_id, event_id, status FROM ({ARRIVALS}) WHERE NOT in_time"

    def streamed(s: Sql) -> None:
        source = f"SELECT request_id AS image_id, prompt, seed FROM ({REQUESTS}) JOIN ({ROUTES}) USING (model_id, op)"
        glyphs(s, "render", source, 24, 24)
        spritified(s, "sprite", "render", 14, 12, 10, 10, 6)

    final("streamed_sprites", streamed, digest("sprite", "r", "g", "b", "a", "nr", "ng", "nb"))

    # Extension surface
    post = lambda c: f"{c} // 64 * 64 AS {c}"
    final("user_operator", part_glyphs,
          f"SELECT image_id, width, height, x, y, {post('r')}, {post('g')}, {post('b')}, a FROM glyph")
    final(
        "sql_functions", part_glyphs,
        "SELECT image_id, x, y, (299*r + 587*g + 114*b) / 255000.0::DOUBLE AS luma, "
        "CASE WHEN a >= 128 THEN 255 ELSE 0 END AS alpha, substr(sha256(image_id || ':' || x), 1, 6) AS color FROM glyph",
    )
    final("sql_glyph_function", lambda s: part_glyphs(s, 7, 9), "SELECT image_id, x, y, r, g, b, a FROM glyph")
    out["model_outputs"] = (
        "SELECT CAST(p_partkey AS VARCHAR) AS image_id, 8 AS width, 6 AS height, CAST(c.range AS INTEGER) AS x, CAST(l.range AS INTEGER) AS y, "
        "CAST((7 * c.range + 13 * l.range + 31 * p_partkey) % 256 AS INTEGER) AS r, "
        "CAST((c.range * l.range + length(p_name)) % 256 AS INTEGER) AS g, "
        "CAST(40 + 180 * ((c.range + l.range) % 2) AS INTEGER) AS b, 255 AS a FROM part, range(8) c, range(6) l WHERE p_size <= 45"
    )
    out["typed_templates"] = (
        "SELECT event_id, user_id + 1 AS next_seed, event_type = 'purchase' AS buys, '{\"note\":\"${user} x\",\"on\":{\"${kind}\":[' || "
        "(event_type = 'purchase')::VARCHAR || ',1,\"' || event_type || '\"]},\"seed\":' || user_id || '}' AS node FROM events"
    )
    out["declared_image_integrity"] = (
        "SELECT CAST(p_partkey AS VARCHAR) AS image_id, CASE WHEN kept THEN 15 ELSE 0 END::BIGINT AS pixels, "
        "CASE WHEN kept THEN 15 ELSE 0 END::BIGINT AS positions, 15::BIGINT AS expected, 0::BIGINT AS misplaced, 0::BIGINT AS bad_values, "
        "kept AND told AS ok FROM (SELECT p_partkey, p_partkey % 3 <> 0 AS kept, p_partkey % 4 <> 0 AS told FROM part) WHERE kept OR told"
    )
    final("image_color_estimates", part_glyphs, "SELECT image_id, count(DISTINCT (r * 256 + g) * 256 + b) AS colors, true AS close FROM glyph GROUP BY image_id")
    sized_part = "(SELECT s.*, p_size FROM sized s JOIN (SELECT CAST(p_partkey AS VARCHAR) AS image_id, p_size FROM part) USING (image_id))"
    final(
        "routed_inference", sized_glyphs,
        f"SELECT image_id, width, height, x, y, 255 - r AS r, 255 - g AS g, 255 - b AS b, a FROM {sized_part} WHERE p_size % 3 = 0 "
        "UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(w AS INTEGER), 5, CAST(c.range AS INTEGER), CAST(l.range AS INTEGER), "
        "CAST((7 * c.range + 13 * l.range + 31 * p_partkey) % 256 AS INTEGER), CAST((c.range * l.range + length(p_name)) % 256 AS INTEGER), "
        "CAST(40 + 180 * ((c.range + l.range) % 2) AS INTEGER), 255 FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 5 + 4 ELSE 8 END AS w "
        "FROM part WHERE p_size % 3 <> 0 AND p_size <= 45 AND p_size <> 7) t, range(8) c, range(5) l WHERE c.range < w",
    )
    out["routed_inference_rejects"] = (
        "SELECT request_id, op, model_id, format('LookupError: no adapter serves op=''{}'' model_id=''{}''', op, model_id) AS reason "
        "FROM (SELECT CAST(p_partkey AS VARCHAR) AS request_id, CASE WHEN p_size > 45 THEN 'text2vid' ELSE 'text2img' END AS op, "
        "CASE WHEN p_size = 7 THEN 'unknown' ELSE 'stub-image' END AS model_id FROM part WHERE p_size % 3 <> 0 AND (p_size > 45 OR p_size = 7))"
    )
    final("glyph_table_function", lambda s: part_glyphs(s, 7, 9), "SELECT image_id, x, y, r, g, b, a FROM glyph")
    out["model_errors"] = (
        "SELECT CAST(p_partkey AS VARCHAR) AS request_id, 'text2vid' AS op, "
        "'LookupError: adapter pattern has no text2vid for stub-image' AS reason FROM part WHERE p_size > 45"
    )

    # Composite pipelines
    rows("spritify", lambda s: spritified(s, "sprite", cutouts(s), 9, 10, 6, 7, 5), f"{PIXEL}, nr, ng, nb")
    rows("single_sprite", lambda s: spritified(s, "sprite", part_glyphs(s, 24, 24), 14, 12, 10, 10, 6),
         f"{PIXEL}, nr, ng, nb")
    rows("requested_sprites", requested, f"{PIXEL}, nr, ng, nb")
    out["requested_sprite_rejects"] = (
        "SELECT CAST(p_partkey AS VARCHAR) AS image_id, 'ValueError: not usable: ' || "
        "CASE p_partkey % 5 WHEN 0 THEN 'width=wide' ELSE 'colors=null' END AS reason "
        "FROM part WHERE p_size > 40 AND p_partkey % 5 < 2"
    )
    final("animation_sheets", lambda s: strip(s, normals(s, "shaded", sized_glyphs(s)), ", nr, ng, nb"),
          digest("strip", "r", "g", "b", "a", "nr", "ng", "nb"))
    seeds = (
        "SELECT CAST(p_partkey AS VARCHAR) || '#' || s.range AS image_id, p_name AS prompt, s.range AS seed "
        "FROM part, range(3) s"
    )
    rows("candidate_batch", lambda s: glyphs(s, "made", seeds, 5, 4))
    out["candidate_members"] = (
        "SELECT CAST(p_partkey AS VARCHAR) AS batch_id, CAST(p_partkey AS VARCHAR) || '#' || s.range AS image_id "
        "FROM part, range(3) s"
    )
    return out


ORACLE = build()
