"""Boosted trees that ``pii_fit`` fitted: fixed values, held-out accuracy 0.994."""

BASE_SCORE = 0.0040
THRESHOLDS = {'secret': 0.5, 'key': 0.5, 'local_phone': 0.5, 'spelled_email': 0.5}
#: (feature, threshold) at the top, left and right, then the four leaves.
TREES = [
    (('valid', 0.0), ('uppers', 23.0), ('length', 13.0), [-0.984, -0.848, -0.639, 0.994]),
    (('valid', 0.0), ('marks', 25.0), ('length', 13.0), [-0.669, -0.576, -0.367, 0.681]),
    (('cue', 0.0), ('runs', 0.0), ('digits', 10.0), [-0.354, 0.584, 0.505, 1.746]),
    (('valid', 0.0), ('uppers', 0.0), ('length', 13.0), [-0.555, -0.482, -0.316, 0.591]),
    (('cue', 0.0), ('length', 19.0), ('digits', 10.0), [-0.486, 0.236, 0.367, 0.789]),
    (('valid', 0.0), ('uppers', 0.0), ('length', 13.0), [-0.526, -0.418, -0.2, 0.544]),
    (('cue', 0.0), ('lowers', 0.0), ('digits', 10.0), [-0.449, 0.201, 0.247, 0.644]),
    (('valid', 0.0), ('uppers', 0.0), ('length', 13.0), [-0.508, -0.269, -0.128, 0.511]),
    (('cue', 0.0), ('length', 13.0), ('digits', 10.0), [-0.501, 0.071, 0.158, 0.565]),
    (('valid', 0.0), ('uppers', 0.0), ('length', 13.0), [-0.486, -0.223, -0.065, 0.49]),
    (('cue', 0.0), ('lowers', 0.0), ('digits', 10.0), [-0.379, 0.113, 0.103, 0.51]),
    (('valid', 0.0), ('uppers', 0.0), ('length', 13.0), [-0.466, -0.05, -0.054, 0.47]),
]
