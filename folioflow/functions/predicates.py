"""Tests on balloon rows, as column expressions. A null flag counts as false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import geometry as g
from folioflow.functions import text as t

#: Style fields whose presence means that a balloon was formatted by hand.
MANUAL_STYLE = (
    "manual_font_size", "manual_line_spacing", "manual_align", "manual_bold", "manual_italic", "manual_underline", "manual_outline_enable",
)

#: What a balloon's source says where its mask is the balloon's own shape, and the mark of a text that is left out.
SHAPE_SOURCE, LEFT_OUT = "yolov8seg", "-"


def truthy(column: Column, kind: str) -> Column:
    """A flag that is set, a number other than zero, or a text with characters."""
    test = {"boolean": column, "string": F.char_length(column) > 0}.get(kind, column != 0)
    return F.coalesce(test, F.lit(False))


def is_valid_text(text: Column) -> Column:
    """A text to draw: not blank, and not the mark for leaving the balloon as it is."""
    said = t.strip(F.coalesce(text, F.lit("")))
    return (said != "") & (said != "-")


def has_manual_style(kinds: dict[str, str]) -> Column:
    """Whether any style field among the columns (name: type) is set."""
    found = F.lit(False)
    for name in MANUAL_STYLE:
        if name in kinds:
            found = found | truthy(F.col(name), kinds[name])
    return found


def extends_to_box(manual_box: Column, split: Column) -> Column:
    """A box enlarged by hand, not one that a split made."""
    return F.coalesce(manual_box, F.lit(False)) & ~F.coalesce(split, F.lit(False))


def shares_size(manual: Column, text: Column, true_shape: Column) -> Column:
    """Balloons that take part in a page's common font size."""
    return ~F.coalesce(manual, F.lit(False)) & ~t.is_shout(text) & F.coalesce(true_shape, F.lit(False))


def ink_color(brightness: Column) -> Column:
    """White on dark ground, else black."""
    return F.when(brightness < 128, "white").otherwise("black")


def positive_number(text: Column, kind: str = "int") -> Column:
    """A number above zero, cut to a whole one for ``int``, else null."""
    n = t.strip(text).try_cast("double")
    n = n.cast("int") if kind == "int" else n
    return F.when(n > 0, n)


def needs_attention(suspect: Column, overflow: Column, translated: Column) -> Column:
    """Balloons that a reviewer should look at: an empty reading that seems to be text, or a cut translation."""
    said = t.strip(F.coalesce(translated, F.lit(""))) != ""
    return (F.coalesce(suspect, F.lit(False)) & ~said) | (F.coalesce(overflow, F.lit(False)) & said)


def render_params(translated: Column, box: Column, manual_box: Column, manual_style: Column, shape: Column, source: Column) -> Column:
    """``text, bbox, manual, trusted`` of a balloon to be drawn; null if it has no text or the mark ``-``.

    A recreated ellipse takes its text in the box inscribed in it, as a manual box.
    """
    said = t.strip(F.coalesce(translated, F.lit("")))
    ellipse = F.coalesce(shape == "ellipse", F.lit(False))
    manual = ellipse | F.coalesce(manual_box, F.lit(False)) | F.coalesce(manual_style, F.lit(False))
    drawn = F.struct(
        said.alias("text"), F.when(ellipse, g.inscribed_box(box)).otherwise(box).alias("bbox"), manual.alias("manual"),
        F.coalesce(source == SHAPE_SOURCE, F.lit(False)).alias("trusted"),
    )
    return F.when((said != "") & (said != LEFT_OUT), drawn)
