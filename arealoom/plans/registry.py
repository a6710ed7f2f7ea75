"""Fixed lists of the Dutch layers: label maps, municipality codes, boundary levels, scales. Functions take such lists
as arguments, so that others can be used instead."""

#: Labels of the coded dimensions of the cubes.
AGE = {1: "Jonger dan 18", 2: "18-23", 3: "24-29", 4: "30-40", 5: "40-59", 6: "60+"}
INCOME = {1: "< 20%", 2: "20-40%", 3: "40-60%", 4: "60-80%", 5: "80-100%"}
EDUCATION = {1: "Laag", 2: "Midden", 3: "Hoog"}
POSITION = {1: "Actief (werkend)", 2: "Uitkering", 3: "Pensioen", 4: "Scholier/student"}

#: Municipalities of the inner region, and the nested boundary levels.
INNER = ["GM0489", "GM0502", "GM0542", "GM0556", "GM0597", "GM0599", "GM0606", "GM0613", "GM0622", "GM1621", "GM1930", "GM1992"]
LEVELS = {
    "level1_full": INNER,
    "level2_mid": ["GM0489", "GM0502", "GM0542", "GM0556", "GM0597", "GM0599", "GM0606", "GM0613", "GM0622", "GM1621"],
    "level3_core": ["GM0489", "GM0597", "GM0599", "GM0613"],
    "level4_rotterdam": ["GM0599"],
}

#: Scales and the columns that identify their areas; grids are points, the others polygons.
SCALES = {"100m": "crs28992res100m", "500m": "crs28992res500m", "buurt": "buurtcode", "pc4": "postcode", "wijk": "wijkcode", "gemeente": "gemeentecode"}
