"""Configuration as data: profile overlay and catalogue, precedence, violations, geometry, window picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import unicode
from pagewright.functions.text import literal, strip

# Enumerations and limits.
CAPTURE_MODES = ("manual", "window_full", "window_left_third", "window_right_third", "screen_left_third")
STYLES = ("full", "prose", "raw")
FORCE_PHASES = ("", "capture", "ocr", "pdf", "all")
OUTPUT_MODES = ("images", "pdf", "text")
BACKENDS = ("printwindow", "screen")
KEY_DELIVERIES = ("auto", "sendinput", "postmessage", "postmessage_top", "pyautogui")
MOST_TRIM = 0.45
RECT = ("left", "top", "width", "height")
# A config's scalar fields with their types and defaults.
DEFAULTS = {
    "n_pages": ("int", 1), "start_page": ("int", 1), "capture_mode": ("string", "manual"), "target_window_title": ("string", ""),
    "use_window_client_rect": ("boolean", True), "prefer_foreground_window_match": ("boolean", True), "window_capture_backend": ("string", "printwindow"),
    "hide_cursor_during_capture": ("boolean", False), "debug_capture": ("boolean", False), "debug_capture_max_pages": ("int", 5), "delay_sec": ("double", 1.0),
    "stop_repeat_pages": ("int", 2), "next_key": ("string", "pagedown"), "reader_focus_clicks": ("int", 2), "reader_focus_x_ratio": ("double", 0.5),
    "reader_focus_y_ratio": ("double", 0.5), "focus_click_settle_sec": ("double", 1.0), "key_delivery": ("string", "auto"), "fit_on_start": ("boolean", False),
    "start_focus_clicks": ("int", 0), "start_focus_x_ratio": ("double", 0.5), "start_focus_y_ratio": ("double", 0.5), "output_mode": ("string", "pdf"),
    "skip_capture": ("boolean", False), "resume": ("boolean", True), "force_phase": ("string", ""), "ocr_lang": ("string", "eng"), "ocr_text_prompt": ("string", ""),
    "ocr_prompt_file": ("string", ""), "assemble_style": ("string", "full"), "input_pdf": ("string", ""), "reader_profile": ("string", ""),
}
# What all built-in profiles share, and what each sets of its own.
PROFILE_BASE = {
    "capture_mode": "screen_left_third", "window_capture_backend": "screen", "use_window_client_rect": True, "hide_cursor_during_capture": True, "delay_sec": 2.0,
    "reader_focus_clicks": 2, "reader_focus_x_ratio": 0.5, "reader_focus_y_ratio": 0.5, "focus_click_settle_sec": 1.0, "fit_on_start": False,
    "start_focus_clicks": 0, "start_focus_x_ratio": 0.5, "start_focus_y_ratio": 0.5, "target_window_title": None,
    "trim_left": 0.0, "trim_right": 0.0, "trim_top": 0.0, "trim_bottom": 0.0, "trim_fill_top": 0.0, "trim_fill_bottom": 0.0,
}
PROFILES = (
    {"name": "kindle_app", "next_key": "right", "key_delivery": "sendinput", "target_window_title": "Kindle", "reader_focus_clicks": 0, "reader_focus_y_ratio": 0.08, "trim_top": 0.035},
    {"name": "kindle_cloud", "next_key": "right", "key_delivery": "pyautogui"},
    {"name": "aladin_app", "next_key": "pagedown", "key_delivery": "sendinput", "trim_top": 0.010, "trim_fill_top": 0.026, "trim_bottom": 0.045},
    {"name": "aladin_web", "next_key": "pagedown", "key_delivery": "pyautogui"},
)

CLICKS = ("reader_focus_clicks", "start_focus_clicks")
RATIOS = ("start_focus_x_ratio", "start_focus_y_ratio", "reader_focus_x_ratio", "reader_focus_y_ratio")
TRIMS = ("trim_left", "trim_right", "trim_top", "trim_bottom", "trim_fill_top", "trim_fill_bottom")


def trim_faults(prefix: str = "") -> list[tuple[Column, str]]:
    """Rules for the six trims: each in its range, and not all of a side."""
    c = lambda n: F.coalesce(F.col(prefix + n), F.lit(0.0))
    return [*((~c(n).between(0.0, MOST_TRIM), n) for n in TRIMS), (c("trim_left") + c("trim_right") >= 1.0, "trim width"),
            (c("trim_top") + c("trim_fill_top") + c("trim_bottom") + c("trim_fill_bottom") >= 1.0, "trim height")]


def overlay(configs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each config's columns replaced by its profile's where that has a value; clicks 0-5, ratios 0-1.

    Key deliveries and trims of a profile that is used are validated: a wrong one raises.
    """
    own = [c for c in configs.columns if c != "reader_profile"]
    known = set(profiles.columns)
    joined = configs.alias("c").join(profiles.alias("p"), F.col("c.reader_profile") == F.col("p.name"), "left")
    faults = trim_faults("p.") if set(TRIMS) <= known else []
    wrong = F.concat_ws(", ", *(F.when(rule, F.lit(name)) for rule, name in faults)) if faults else F.lit("")

    def value(name: str) -> Column:
        if name not in known or name == "name":
            return F.col(f"c.{name}")
        given = F.col(f"p.{name}")
        if name in CLICKS:
            given = F.least(F.greatest(given, F.lit(0)), F.lit(5))
        elif name in RATIOS:
            given = F.least(F.greatest(given, F.lit(0.0)), F.lit(1.0))
        elif name == "key_delivery":
            given = normalized(given, KEY_DELIVERIES, "auto")
        elif name in TRIMS and faults:
            given = F.when(wrong == "", given).otherwise(F.raise_error(F.concat(F.lit("profile trims out of range: "), wrong)))
        return F.when(F.col(f"p.{name}").isNotNull(), given).otherwise(F.col(f"c.{name}"))

    return joined.select("c.reader_profile", *(value(n).alias(n) for n in own))


def catalogue(builtin: DataFrame, from_file: DataFrame) -> DataFrame:
    """Profiles by name: a file's row replaces a built-in one whole and keeps its place; the last of a file wins."""
    both = builtin.withColumn("priority", F.lit(0)).unionByName(from_file.withColumn("priority", F.lit(1)))
    newest = Window.partitionBy("name").orderBy(F.desc("priority"), F.desc("ord"))
    place = F.min(F.struct("priority", "ord")).over(Window.partitionBy("name"))
    return (both.withColumn("rn", F.row_number().over(newest)).withColumn("place", place).where("rn = 1")
            .withColumn("position", F.row_number().over(Window.orderBy("place"))).drop("rn", "priority", "ord", "place"))


def builtin_profiles(spark: SparkSession) -> DataFrame:
    """The four built-in profiles, in order (``ord``)."""
    rows = [{"ord": i} | PROFILE_BASE | own for i, own in enumerate(PROFILES)]
    kinds = {bool: "boolean", int: "int", float: "double", str: "string", type(None): "string"}
    schema = ", ".join(f"{name} {kinds[type(value)]}" for name, value in (rows[0] | {"target_window_title": ""}).items())
    return spark.createDataFrame([tuple(r.values()) for r in ({k: r[k] for k in rows[0]} for r in rows)], schema)


def set_fields(files: DataFrame) -> DataFrame:
    """(config, ...) of (config, value) JSON rows: what each file sets itself, null elsewhere; trims nested or flat."""
    v = files.withColumn("v", F.expr("try_parse_json(value)"))
    get = lambda path, kind: F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    trims = [F.coalesce(get(f"pdf_trim.{n[5:]}", "double"),
                        F.when(F.expr("schema_of_variant(variant_get(v, '$.pdf_trim', 'variant')) LIKE 'OBJECT%'"), F.lit(0.0)).otherwise(get(f"pdf_{n}", "double"))).alias(n) for n in TRIMS]
    return v.select("config", *(get(name, kind).alias(name) for name, (kind, _) in DEFAULTS.items()),
                    *(get(f"rect.{n}", "int").alias(f"rect_{n}") for n in RECT), *trims)


def with_defaults(fields: DataFrame) -> DataFrame:
    """Every field or its default."""
    filled = {n: F.coalesce(n, F.lit(d).cast(k)) for n, (k, d) in DEFAULTS.items()} | {f"rect_{n}": F.coalesce(f"rect_{n}", F.lit(0)) for n in RECT} | {n: F.coalesce(n, F.lit(0.0)) for n in TRIMS}
    return fields.withColumns({n: c for n, c in filled.items() if n in fields.columns})


def configs(files: DataFrame) -> DataFrame:
    """(config, ...) of (config, value) JSON rows: every field or its default, the rectangle, and trims nested or flat."""
    return with_defaults(set_fields(files))


def resolve(files: DataFrame, arguments: DataFrame, profiles: DataFrame) -> DataFrame:
    """Configs from files (config, value), command lines (config, fields that are set, else null) and profiles by name.

    The command line wins over the profile, the profile over the file, the file over the
    defaults; the profile is that of the command line, else of the file.  A rectangle
    counts only when all four of its numbers are given.
    """
    fields = with_defaults(set_fields(files)).alias("f").join(arguments.alias("a"), "config", "left")
    given = set(arguments.columns) - {"config"}
    profile = F.coalesce(F.nullif(F.col("a.reader_profile"), F.lit("")), F.col("f.reader_profile")) if "reader_profile" in given else F.col("f.reader_profile")
    names = [n for n in (*DEFAULTS, *(f"rect_{n}" for n in RECT), *TRIMS) if n != "reader_profile"]
    layered = overlay(fields.select("config", profile.alias("reader_profile"), *(F.col(f"f.{n}").alias(n) for n in names)), profiles)
    whole = F.lit(True)
    for n in RECT:
        whole &= F.col(f"a.rect_{n}").isNotNull() if f"rect_{n}" in given else F.lit(False)
    asked = lambda n: F.when(whole, F.col(f"a.{n}")) if n.startswith("rect_") else F.col(f"a.{n}")
    top = layered.alias("l").join(arguments.alias("a"), "config", "left")
    return top.select("config", "l.reader_profile", *(precedence(asked(n), F.col(f"l.{n}")).alias(n) if n in given else F.col(f"l.{n}") for n in names))


def settled(configs: DataFrame) -> DataFrame:
    """Resolved configs as they are used: enumerations trimmed and lower-cased (unknown output modes and key deliveries raise), at least one page when debugging."""
    given = {"output_mode": normalized(F.col("output_mode"), OUTPUT_MODES, "pdf"), "key_delivery": normalized(F.col("key_delivery"), KEY_DELIVERIES, "auto"),
             "capture_mode": F.expr(strip("capture_mode")), "assemble_style": F.lower(F.expr(strip("assemble_style"))), "target_window_title": F.expr(strip("target_window_title")),
             "debug_capture_max_pages": F.greatest(F.lit(1), "debug_capture_max_pages")}
    return configs.withColumns({n: c for n, c in given.items() if n in configs.columns})


def checked(configs: DataFrame) -> DataFrame:
    """(.., violations) of settled configs; ``base_dir`` and ``pdf_pages`` (0: the input is no PDF) are columns besides."""
    named = configs.withColumns({"window_title": F.col("target_window_title"), "settle_sec": F.col("focus_click_settle_sec")})
    return violations(named).drop("window_title", "settle_sec")


def can_screen_capture(mode: str = "capture_mode", title: str = "target_window_title") -> Column:
    """A manual capture needs a rectangle with a size, any other a window title that is not blank."""
    return F.when(F.col(mode) == "manual", (F.col("rect_width") >= 1) & (F.col("rect_height") >= 1)).otherwise(
        F.regexp_replace(title, r"(?U)\s+", "") != "")


def precedence(*layers: Column) -> Column:
    """Command line, profile, file, default: the first that is set."""
    return F.coalesce(*layers)


def normalized(value: Column, known: tuple[str, ...], default: str = "") -> Column:
    """Trimmed and lower-cased member of an enumeration, ``default`` for nothing; anything else raises."""
    value = F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
    text = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    return F.when(text.isin(*known), text).otherwise(F.raise_error(F.concat(F.lit("not one of the known values: "), value)))


def violations(configs: DataFrame) -> DataFrame:
    """(.., violations): every rule that a config breaks, in order.

    A PDF as input (pdf_pages > 0) or skip_capture means that nothing is captured, and
    rules of capturing don't hold then; key deliveries are compared trimmed and lower-cased.
    """
    c = F.col
    captures = (c("pdf_pages") == 0) & ~c("skip_capture")
    window = captures & (c("capture_mode") != "manual")
    rules = [
        (~c("capture_mode").isin(*CAPTURE_MODES), "capture_mode"), (~c("n_pages").between(1, 10000), "n_pages"),
        (~c("start_page").between(1, 999999), "start_page"), (~c("assemble_style").isin(*STYLES), "assemble_style"),
        ((c("pdf_pages") > 0) & (c("start_page") > c("pdf_pages")), "start_page beyond pdf"),
        ((c("pdf_pages") > 0) & (c("start_page") + c("n_pages") - 1 > c("pdf_pages")), "pages beyond pdf"),
        (captures & (c("capture_mode") == "manual") & ((c("rect_width") < 1) | (c("rect_height") < 1)), "rect"),
        (window & (F.trim("window_title") == ""), "window_title"),
        (window & ~c("window_capture_backend").isin(*BACKENDS), "window_capture_backend"),
        (~c("base_dir").rlike(r"^(/|[A-Za-z]:|\\\\)"), "base_dir"), (~c("force_phase").isin(*FORCE_PHASES), "force_phase"),
        *((~c(n).between(0, 5), n) for n in CLICKS), *((~c(n).between(0.0, 1.0), n) for n in RATIOS),
        (~c("settle_sec").between(0.0, 10.0), "settle_sec"), *trim_faults(),
        (~F.lower(F.trim("key_delivery")).isin("", *KEY_DELIVERIES), "key_delivery"),
    ]
    return configs.withColumn("violations", F.array_compact(F.array(*(F.when(rule, F.lit(name)) for rule, name in rules))))


def capture_rect(mode: str = "capture_mode") -> dict[str, Column]:
    """Left third, right third or the whole of a window; at least one pixel wide."""
    third = F.greatest(F.lit(1), F.expr("width div 3"))
    right = F.col(mode) == "window_right_third"
    return {
        "rect_left": F.when(right, F.col("x") + 2 * third).otherwise(F.col("x")).cast("int"), "rect_top": F.col("y"),
        "rect_width": F.when(F.col(mode) == "window_left_third", third).when(right, F.greatest(F.lit(1), F.col("width") - 2 * third))
        .otherwise(F.col("width")).cast("int"), "rect_height": F.col("height")}


def trim_geometry(images: DataFrame) -> DataFrame:
    """Crop box, white bands and page size in points of (width, height, dpi, trim_*) rows; halves round to even."""
    pixels = lambda size, ratio: F.bround(F.col(size) * F.col(ratio), 0).cast("int")
    box = images.select("*", pixels("width", "trim_left").alias("crop_left"), pixels("height", "trim_top").alias("crop_top"),
                        (F.col("width") - pixels("width", "trim_right")).cast("int").alias("crop_right"),
                        (F.col("height") - pixels("height", "trim_bottom")).cast("int").alias("crop_bottom"))
    dpi = F.when(F.coalesce("dpi", F.lit(0.0)) <= 1.0, 72.0).otherwise(F.col("dpi"))
    return box.select(
        "*", ((F.col("crop_right") - F.col("crop_left") >= 2) & (F.col("crop_bottom") - F.col("crop_top") >= 2)).alias("enough"),
        F.least("crop_bottom", F.col("crop_top") + pixels("height", "trim_fill_top")).alias("top_band_end"),
        F.greatest("crop_top", F.col("crop_bottom") - pixels("height", "trim_fill_bottom")).alias("bottom_band_start"),
        ((F.col("crop_right") - F.col("crop_left")) * 72.0 / dpi).alias("width_pt"),
        ((F.col("crop_bottom") - F.col("crop_top")) * 72.0 / dpi).alias("height_pt"))


def histogram_means(histograms: DataFrame) -> DataFrame:
    """(image, mean_diff) of (image, level, count): the count-weighted mean level."""
    return histograms.groupBy("image").agg((F.sum(F.col("level") * F.col("count")) / F.sum("count")).alias("mean_diff"))


def mostly_black(means: DataFrame, limit: float = 14.0) -> DataFrame:
    """(image, black) of (image, r, g, b): mean of the channel means under the limit."""
    return means.select("image", ((F.col("r") + F.col("g") + F.col("b")) / 3 < limit).alias("black"))


def titles_like(windows: DataFrame, needle: str) -> DataFrame:
    """Windows whose title contains ``needle`` in either case."""
    return windows.where(f"contains({unicode.casefold('title')}, {unicode.casefold(literal(needle))})")


def distinct_titles(windows: DataFrame) -> DataFrame:
    return windows.where(F.trim("title") != "").select("title").distinct().orderBy("title")


def pick_window(windows: DataFrame) -> DataFrame:
    """(query, hwnd) of (query, hwnd, title, foreground, ord): foreground, else the exact title, else the first."""
    rank = F.struct((~F.col("foreground")).alias("a"), (F.col("title") != F.col("query")).alias("b"), F.col("ord").alias("c"))
    return windows.where(f"contains({unicode.casefold('title')}, {unicode.casefold('query')})").groupBy("query").agg(F.min_by("hwnd", rank).alias("hwnd"))


def largest_child(children: DataFrame) -> DataFrame:
    """(parent, hwnd) of the largest area; the first of equals."""
    return children.groupBy("parent").agg(F.max_by("hwnd", F.struct((F.col("width") * F.col("height")).alias("area"), (-F.col("ord")).alias("o"))).alias("hwnd"))
