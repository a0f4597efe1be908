"""A user's feature file, as cfg_add_json reads it: functions of (x [regions x samples], **parameters) giving (values, labels)."""


def peak_to_peak(x, factor=1.0):
    return factor * (x.max(axis=1) - x.min(axis=1)), [f"peak_to_peak_{i}" for i in range(len(x))]


def energy_share(x):
    energy = (x * x).sum(axis=1)
    return energy / energy.sum(), [f"energy_share_{i}" for i in range(len(x))]
