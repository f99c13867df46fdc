"""Per-pixel rules: quality bits, temperature, vegetation index, exclusions, change states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonemill import model as M
from zonemill.functions.numbers import clamp, finite


def classify_quality(dn: Column, qa_pixel: Column, qa_radsat: Column) -> Column:
    """0 missing, 1 clear, 2 cloud. Cloud needs a filled footprint, clear also range and no saturation."""
    footprint = qa_pixel.bitwiseAND(F.lit(M.FILL_BIT)) == 0
    cloud = qa_pixel.bitwiseAND(F.lit(M.CLOUD_BITS)) != 0
    saturated = qa_radsat.bitwiseAND(F.lit(M.SATURATION_BITS)) != 0
    return (F.when(footprint & cloud, 2)
            .when(footprint & dn.between(M.MINIMUM_DN, 65535) & ~saturated, 1).otherwise(0))


def surface_temperature(dn: Column) -> Column:
    return dn * F.lit(M.TEMPERATURE_SCALE) + F.lit(M.TEMPERATURE_OFFSET_K) - F.lit(M.KELVIN_OFFSET)


def temperature_uncertainty(dn: Column) -> Column:
    return dn * F.lit(M.UNCERTAINTY_SCALE)


def encode_temperature(t: Column, status: Column) -> Column:
    """Byte on the 15–50 °C range, 0 where the pixel is not clear."""
    share = clamp((t - M.TEMPERATURE_MIN) / (M.TEMPERATURE_MAX - M.TEMPERATURE_MIN), 0.0, 1.0)
    return F.when((status == 1) & finite(t), F.rint(share * 255.0).cast("int")).otherwise(0)


def temperature_position(t: Column) -> Column:
    """Position on the legend, 0 to 100; 0 without a value."""
    share = (t - M.TEMPERATURE_MIN) / (M.TEMPERATURE_MAX - M.TEMPERATURE_MIN)
    return F.when(finite(t), clamp(share * 100.0, 0.0, 100.0)).otherwise(0.0)


def valid_scene_pixel(data_mask: Column, scene_class: Column) -> Column:
    return (data_mask == 1) & ~scene_class.isin(M.MASKED_SCENE_CLASSES)


def ndvi(red: Column, nir: Column, epsilon: float = 2.220446049250313e-16) -> Column:
    """(nir − red)/(nir + red), null for non-finite input, a vanishing sum or a value outside [−1, 1].

    ``epsilon=0`` gives the variant that only rejects an exact zero sum.
    """
    total = nir + red
    value = F.when(finite(red) & finite(nir) & (F.abs(total) > epsilon), (nir - red) / total)
    return F.when(finite(value) & value.between(-1.0, 1.0), value)


def exclusion_reason(land_cover: Column, land_use: Column) -> Column:
    """``water`` first, then ``cropland`` (crops outside pastures, grass on arable land), else null."""
    use = land_use.cast("string")
    crops = (land_cover == 40) & ~F.coalesce(use == "23000", F.lit(False))
    arable_grass = (land_cover == 30) & (use == "21000")
    return F.when(use == "50000", "water").when(crops | arable_grass, "cropland")


def classify_vegetation(index: Column, valid: Column, reason: Column, threshold: Column | float) -> Column:
    return (F.when(~F.coalesce(valid, F.lit(False)) | ~finite(index), "no-data")
            .when(reason.isNotNull(), "excluded")
            .when(index >= threshold, "likely-vegetated").otherwise("below-threshold"))


def classify_soil(coverage: Column, fraction: Column) -> Column:
    """1 when more than half is sealed, 2 when less, 0 for a tie or too little coverage."""
    usable = finite(coverage) & finite(fraction) & (coverage >= 0.5)
    return F.when(usable & (fraction > 0.5), 1).when(usable & (fraction < 0.5), 2).otherwise(0)


def change_state(before: Column, after: Column, known: list[int], vegetation: list[int]) -> Column:
    """1 vegetation gained, 2 lost, 0 otherwise (also when either code is unknown)."""
    usable = comparable(before, after, known)
    return (F.when(usable & ~before.isin(vegetation) & after.isin(vegetation), 1)
            .when(usable & before.isin(vegetation) & ~after.isin(vegetation), 2).otherwise(0))


def comparable(before: Column, after: Column, known: list[int]) -> Column:
    classified = [code for code in known if code != M.LAND_COVER_UNCLASSIFIABLE]
    return F.coalesce(before.isin(classified) & after.isin(classified), F.lit(False))


def temperature_bin(t: Column) -> Column:
    """0.5 °C bin on 15–50 °C, last bin closed on the right; null outside."""
    last = int((M.TEMPERATURE_MAX - M.TEMPERATURE_MIN) / M.TEMPERATURE_BIN) - 1
    index = F.floor((t - M.TEMPERATURE_MIN) / M.TEMPERATURE_BIN).cast("int")
    return F.when(t.between(M.TEMPERATURE_MIN, M.TEMPERATURE_MAX), F.least(index, F.lit(last)))


def ndvi_bin(index: Column) -> Column:
    """Bin centred on multiples of 0.001 from −1, 0 to 2000."""
    return clamp(F.floor((index + 1.0) / M.NDVI_BIN + 0.5), 0, 2000).cast("int")


def bin_value(b: Column) -> Column:
    return F.round(b * M.NDVI_BIN - 1.0, 3)


def year_status(dataset: Column, year: Column) -> Column:
    """Temporal note of a published year: 2024 provisional, method change from 2023 on."""
    return (F.when((dataset == "jaarbak") & (year == 2024), "provisional")
            .when((dataset == "jaarbak") & (year >= 2023), "method-change").otherwise("reference"))

