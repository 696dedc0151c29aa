"""Did extraction lose a page's information? And how a page would be tiled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
DENSITY, OCCUPANCY, TABLE_DENSITY, ENOUGH_TOKENS, IMAGE_AREA, MISSING_ALT = 0.6, 0.3, 1.0, 500, 0.3, 0.5
MAX_TILES, MIN_SCALE, MAX_SCALE = 10, 0.5, 1.0
PDF_CHARS_A_PAGE = 30


def evaluate_quality(
    extracted_chars: Column, visible_chars: Column, table_cells: Column, canvases: Column, svgs: Column, leaves: Column,
    images: Column, images_without_alt: Column, image_area: Column, tokens: Column, visual_area: Column, table_area: Column,
) -> Column:
    """struct(density, occupancy, missing_alt, low_quality, reason). The last two are measured areas, or null."""
    share = lambda a, b, other: F.when(b > 0, a.cast("double") / F.when(b > 0, b)).otherwise(F.lit(other))
    density = share(extracted_chars, visible_chars, 1.0)
    occupancy = F.coalesce(visual_area, share(table_cells + canvases + svgs, leaves, 0.0))
    missing = share(images_without_alt, images, 0.0)
    enough = tokens >= ENOUGH_TOKENS
    measured = visual_area.isNotNull()
    table = F.when(measured, F.coalesce(table_area, F.lit(0.0))).otherwise(share(table_cells, leaves, 0.0))
    other = F.when(measured, F.greatest(visual_area - F.coalesce(table_area, F.lit(0.0)), F.lit(0.0))).otherwise(share(canvases + svgs, leaves, 0.0))
    counted = F.when((density >= TABLE_DENSITY) | enough, other).otherwise(table + other)
    two = lambda c: F.format_string("%.2f", c)
    reason = (
        F.when((density < DENSITY) & ~enough, F.concat(F.lit("抽出テキスト密度が低いです("), two(density), F.lit(" < 0.6)")))
        .when(counted > OCCUPANCY, F.concat(F.lit("表/canvas/svgの要素占有率が高いです("), two(counted), F.lit(" > 0.3)")))
        .when(
            (image_area > IMAGE_AREA) & (missing > MISSING_ALT) & ~enough,
            F.concat(F.lit("J6: 画像で情報を提供しているページの可能性があります(画像面積比"), two(image_area), F.lit(" > 0.3, alt欠落率"), two(missing), F.lit(" > 0.5)")),
        )
    )
    return F.struct(density.alias("density"), occupancy.alias("occupancy"), missing.alias("missing_alt"), reason.isNotNull().alias("low_quality"), reason.alias("reason"))


def area_share(widths: Column, heights: Column, page_width: Column, page_height: Column) -> Column:
    """Summed areas over the page's, 1 at most, 0 for an empty page."""
    total = F.aggregate(F.zip_with(widths, heights, lambda w, h: w.cast("double") * h), F.lit(0.0), lambda a, x: a + x)
    page = page_width.cast("double") * page_height
    return F.when(page > 0, F.least(total / F.when(page > 0, page), F.lit(1.0))).otherwise(0.0)


def tile_plan(page_width: Column, page_height: Column, tile_width: Column, tile_height: Column) -> Column:
    """array<struct<x, y, width, height>> from the top: one tile at least, MAX_TILES at most."""
    total = F.greatest(page_height, F.lit(1))
    n = F.least(F.lit(MAX_TILES), F.ceil(total / tile_height).cast("int"))
    width = F.when(page_width > 0, F.least(page_width, tile_width)).otherwise(tile_width)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.lit(0).alias("x"), (i * tile_height).alias("y"), width.alias("width"), F.least(tile_height, total - i * tile_height).alias("height")),
    )


def tiles_cut(page_height: Column, tile_height: Column) -> Column:
    return F.ceil(F.greatest(page_height, F.lit(1)) / tile_height) > MAX_TILES


def clamp_scale(scale: Column) -> Column:
    return F.least(F.greatest(scale, F.lit(MIN_SCALE)), F.lit(MAX_SCALE))


def has_text_layer(pages: Column) -> Column:
    """Do a PDF's pages (array of texts) hold PDF_CHARS_A_PAGE trimmed characters on average?"""
    chars = F.aggregate(pages, F.lit(0), lambda a, p: a + F.length(F.trim(F.coalesce(p, F.lit("")))))
    return (F.size(pages) > 0) & (chars >= F.size(pages) * PDF_CHARS_A_PAGE)


def pdf_markdown(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("## ページ "), (i + 1).cast("string"), F.lit("\n\n"), F.trim(F.coalesce(p, F.lit(""))))), "\n\n")
