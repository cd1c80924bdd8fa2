"""Published figures the rebuild is held to. 66 daily index values from 2026-07-01,
fare means by booking window, and the scores and fits published for them."""

DAILY = [
    99.5098, 103.7501, 102.4095, 101.6959, 98.9543, 96.4298, 98.1169, 98.874,
    103.647, 102.3032, 101.9147, 99.4054, 97.1455, 97.0453, 98.9087, 103.6656,
    102.4542, 102.671, 98.6916, 95.9514, 97.0929, 99.46, 103.8994, 102.7737,
    102.0938, 99.5931, 96.3926, 98.2521, 99.1875, 103.7928, 102.4118, 102.0646,
    98.9893, 96.0754, 98.0165, 99.1827, 103.3411, 103.0248, 101.8474, 99.1131,
    96.8321, 98.2159, 99.397, 103.7937, 102.6398, 102.0704, 98.4952, 96.0175,
    98.3114, 99.7537, 102.8509, 123.0187, 137.2033, 142.5861, 138.3292, 132.8942,
    118.9976, 103.9448, 102.5239, 102.3852, 98.9456, 96.5913, 97.5179, 99.1629,
    103.8123, 102.6328,
]

# route: [(window, n, mean fare)]
WINDOW_MEANS = {
    "BLR-BOM": [(1, 738, 6736.39), (7, 735, 5639.84), (15, 753, 4741.3), (30, 728, 3988.14), (45, 734, 3708.76)],
    "BLR-CCU": [(1, 737, 9599.91), (7, 741, 7912.1), (15, 748, 6563.58), (30, 752, 5497.08), (45, 741, 5133.74)],
    "BLR-DEL": [(1, 753, 9911.59), (7, 770, 7673.63), (15, 740, 6058.81), (30, 731, 4930.38), (45, 747, 4652.31)],
    "BLR-HYD": [(1, 745, 4709.96), (7, 752, 4127.75), (15, 759, 3613.28), (30, 737, 3130.69), (45, 740, 2949.64)],
    "BOM-DEL": [(1, 745, 9629.83), (7, 728, 7185.73), (15, 734, 5572.72), (30, 736, 4511.76), (45, 735, 4287.74)],
    "CCU-DEL": [(1, 719, 9445.02), (7, 739, 7760.33), (15, 748, 6441.78), (30, 744, 5312.01), (45, 733, 4957.48)],
    "DEL-HYD": [(1, 764, 9859.45), (7, 733, 7787.32), (15, 733, 6213.28), (30, 736, 5103.73), (45, 739, 4784.16)],
    "DEL-MAA": [(1, 752, 10797.54), (7, 737, 8632.49), (15, 743, 6946.81), (30, 735, 5702.06), (45, 763, 5328.48)],
}

# route: (floor, amplitude, decay days)
DECAY_FITS = {
    "BLR-BOM": (3574.7860, 0.9491917, 14.097544),
    "BLR-CCU": (4975.8487, 1.0028301, 13.162142),
    "BLR-DEL": (4545.7327, 1.2925098, 11.072412),
    "BLR-HYD": (2824.6645, 0.7110425, 16.064106),
    "BOM-DEL": (4217.5039, 1.4169219, 10.048841),
    "CCU-DEL": (4774.2388, 1.0529316, 13.513139),
    "DEL-HYD": (4665.3920, 1.2140622, 11.656939),
    "DEL-MAA": (5174.6891, 1.1803777, 12.207000),
}

# (model, horizon): (forecasts, MAE, RMSE, MASE)
NOWCAST = {
    ("naive", 1): (45, 3.5313, 5.4489, 0.506),
    ("seasonal_naive", 1): (45, 9.0124, 17.5644, 1.2913),
    ("drift", 1): (45, 3.6075, 5.5053, 0.5169),
    ("damped_trend", 1): (45, 3.7456, 5.393, 0.5367),
    ("seasonal_damped_trend", 1): (45, 3.1488, 7.1075, 0.4512),
    ("naive", 7): (39, 10.3214, 18.866, 1.4789),
    ("seasonal_naive", 7): (39, 10.3214, 18.866, 1.4789),
    ("drift", 7): (39, 11.1711, 20.1485, 1.6006),
    ("damped_trend", 7): (39, 13.6299, 23.9325, 1.9529),
    ("seasonal_damped_trend", 7): (39, 14.421, 29.746, 2.0663),
}

# month: (days, min, max, mean, sd, range, sampled near the 15th)
DISPERSION = {
    "2026-07-01": (31, 95.9514, 103.8994, 100.274, 2.5679, 7.948, 98.9087),
    "2026-08-01": (31, 96.0175, 142.5861, 106.3694, 13.5898, 46.5686, 102.0704),
    "2026-09-01": (4, 97.5179, 103.8123, 100.7815, 2.9373, 6.2944, 102.6328),
}
