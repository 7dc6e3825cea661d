"""The printed items: a small fixed dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Printed sections in sheet order - heading, side, printed column, first
# sheet row, item labels on consecutive rows.
SECTIONS = [
    ("Common & Priority Items", "front", "left", 18, [
        "Cigarette Butts", "Plastic Bottles (beverage)", "Plastic Bags (shopping / grocery)",
        "Plastic Straws", "Plastic Cutlery", "Plastic Cups", "Foam Cups",
        "Foam Take-Out Food Containers", "Plastic Lids (yogurt lids, coffee lids, etc.)",
        "Plastic Food Wrappers (candy, chip bags, etc.)", "Balloons",
        "Large Foam Fragments (larger than a dime)", "Small Foam Fragments (smaller than a dime)",
        "Large Plastic Fragments (larger than a dime)",
        "Small Plastic Fragments (smaller than a dime)",
        "Nurdles (small pre-production plastic pellets)"]),
    ("Food & Beverage Packaging", "front", "right", 35, [
        "Plastic 6-Pack Holders", "Plastic Bags (other: zip-lock, trash, etc.)",
        "Plastic Bottle Caps + Rings", "Juice Boxes", "Foam Plates", "Plastic Plates",
        "Plastic Stirrers", "Plastic Take-Out Food Containers"]),
    ("Personal Care", "front", "right", 44, [
        "Diapers", "Syringes", "Tampons/Tampon Applicators", "Toothbrushes", "Toothpicks/Floss",
        "Bandaids", "Wipes", "Single Use Surgical Mask"]),
    ("Smoking", "back", "left", 53, [
        "Lighters", "Cigar Tips", "Plastic Tobacco Packaging/Wrap", "Vape Cartridges",
        "Single-Use Weed Containers"]),
    ("Fishing", "back", "left", 59, [
        "Bait Bags/Containers", "Buoys/Floats", "Large Foam Pieces",
        "Fishing Line (1 yard = 1 piece)", "Hooks/Sinkers/Lures", "Light Sticks", "Nets",
        "Pots and Traps", "Rope (1 yard = 1 piece)", "Hagfish Traps", "Oyster Spacers"]),
    ("Other (Plastic / Foam)", "back", "left", 71, [
        "Non-Beverage Bottles (bleach, cleaners, oil, etc.)", "Foam Coolers", "Shotgun Wads",
        "Plastic Film/Wrapper (non-food or unknown)", "Zip Ties", "Dog Poop Bags",
        "Mini Toiletry Bottles", "Other (do not write in the item name, just a number)"]),
    ("Glass", "back", "right", 80, [
        "Bottles", "Fragments", "Other (do not write in the item name, just a number)"]),
    ("Paper & Wood", "back", "right", 84, [
        "Paper Bags", "Paper Cigarette Box", "Paper/Wood Cups", "Paper/Wood Fragments/Pieces",
        "Paper Napkins", "Paper/Wood Plates", "Paper/Wood Straws", "Wood Coffee/Drink Stirrers",
        "Paper/Wood Take-Out Food Containers", "Treated Wood (i.e. pallets; NOT driftwood)",
        "Other (do not write in the item name, just a number)"]),
    ("Metal", "back", "right", 96, [
        "Metal Bottle Caps", "Aluminum Cans (beverage)", "Cans (other metal)", "Metal Fragments",
        "Other (do not write in the item name, just a number)"]),
    ("Rubber & Latex", "back", "right", 102, [
        "Condoms", "Latex Gloves", "Tires",
        "Other (do not write in the item name, just a number)"]),
    ("Other Materials", "back", "right", 107, [
        "Fireworks", "Tarps", "Fabric/Textiles",
        "Other (do not write in the item name, just a number)"]),
]

# Header fields and the sheet row their value is written to, in column A.
HEADER_ROWS = {
    "data_entry_volunteer": 2,
    "club": 4,
    "date": 6,
    "shoreline": 8,
    "volunteers": 10,
    "pounds": 12,
    "duration": 14,
}

FIRST_DATA_COLUMN = 3
LAST_DATA_COLUMN = 78
MAX_VOLUNTEERS = LAST_DATA_COLUMN - FIRST_DATA_COLUMN + 1

ITEMS = [
    (first + i, name, section, side, column)
    for section, side, column, first, names in SECTIONS
    for i, name in enumerate(names)
]
ITEM_ROWS = [item[0] for item in ITEMS]

def taxonomy(spark: SparkSession) -> DataFrame:
    """One row per printed item, as an inline relation of fixed size (always broadcastable)."""
    def text(v: str) -> str:
        return "'" + v.replace("'", "\\'") + "'"

    rows = ", ".join(
        f"({row}, {text(name)}, {text(section)}, {text(side)}, {text(column)})"
        for row, name, section, side, column in ITEMS
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS t(item_row, item_name, section, side, printed_column)"
    )
