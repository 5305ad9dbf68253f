"""Published values used as goldens: factor numerators (spectral / 170, terrain / 34) with the fixed rank, and two annual series."""

FACTOR_ROWS = [
    ("c01", 61, 63, 81, 21, 11, 13, 14),
    ("c03", 91, 93, 9, 9, 25, 5, 17),
    ("c04", 85, 111, 105, 11, 19, 7, 12),
    ("c05", 33, 43, 153, 5, 31, 9, 9),
    ("c06", 53, 65, 129, 13, 21, 19, 5),
    ("c07", 31, 35, 141, 29, 1, 27, 6),
    ("c08", 47, 49, 145, 15, 16, 17, 7),
    ("c09", 3, 3, 169, 27, 9, 33, 1),
    ("c10", 67, 75, 113, 23, 13, 11, 10),
    ("c11", 81, 71, 11, 7, 23, 15, 16),
    ("c12", 9, 13, 149, 2, 27, 3, 15),
    ("c13", 35, 39, 133, 31, 3, 25, 4),
    ("c14", 65, 69, 87, 19, 16, 21, 11),
    ("c15", 13, 25, 157, 25, 7, 31, 3),
    ("c16", 29, 41, 155, 2, 31, 1, 13),
    ("c17", 87, 97, 23, 17, 31, 23, 8),
    ("c18", 1, 1, 165, 33, 5, 29, 2),
]
ANNUAL_RAIN = [1496.9499999999998, 1596.5, 1050.4, 1242.35, 1298.25, 1310.3, 1168.4499999999998, 1119.9, 904.5, 618.05, 790.25, 839.8000000000002, 1169.05, 891.45, 953.6999999999999, 826.2, 1005.7500000000001, 988.6, 707.0, 882.5, 878.1, 861.05, 1062.6999999999998, 1117.05, 1310.55, 698.95, 908.1999999999999, 899.9999999999999, 914.2, 1258.3000000000002, 754.2, 771.4, 794.5, 890.2500000000001, 898.75]
DRY_RUNS = [44, 23, 31, 39, 37, 24, 17, 76, 37, 67, 42, 31, 29, 26, 33, 22, 61, 26, 35, 68, 22, 34, 33, 54, 26, 36, 63, 24, 20, 68, 40, 44, 31, 46, 45]
