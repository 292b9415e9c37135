"""Literal tables of the field: frameworks, topics, symmetries, known connections, turning points and records of wrong premises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Competing frameworks as (slug, name, categories, papers expected).
FRAMEWORKS = (
    ("string_theory", "String Theory", ("hep-th",), 30000),
    ("loop_quantum_gravity", "Loop Quantum Gravity", ("gr-qc", "hep-th"), 5000),
    ("cdt", "Causal Dynamical Triangulations", ("hep-th", "gr-qc"), 500),
    ("asymptotic_safety", "Asymptotic Safety", ("hep-th", "gr-qc"), 2000),
    ("causal_sets", "Causal Sets", ("gr-qc", "hep-th"), 800),
    ("horava_lifshitz", "Hořava-Lifshitz Gravity", ("hep-th", "gr-qc"), 1500),
    ("noncommutative_geometry", "Noncommutative Geometry", ("hep-th", "math-ph", "gr-qc"), 2000),
    ("emergent_gravity", "Emergent Gravity / Holographic", ("hep-th", "gr-qc", "quant-ph"), 3000),
)
# Topics that frameworks can be compared on; the last one takes the rest.
TOPICS = (
    "spectral_dimension",
    "newton_correction",
    "black_hole_entropy",
    "bh_entropy_log_correction",
    "area_gap",
    "cosmological_constant",
    "graviton_propagator_modification",
    "entanglement_entropy_area_law",
    "dispersion_relation_modification",
    "heat_kernel_coefficient",
    "running_gravitational_coupling",
    "other",
)
# Fixed values: (slug, diffeomorphisms, Lorentz, foliation, discrete, supersymmetry, duality); None is unknown.
SYMMETRIES = (
    ("string_theory", True, True, False, False, True, True),
    ("loop_quantum_gravity", True, True, False, True, False, False),
    ("cdt", False, False, True, True, False, False),
    ("asymptotic_safety", True, True, False, False, False, False),
    ("causal_sets", False, True, False, True, False, False),
    ("horava_lifshitz", False, False, True, False, False, False),
    ("noncommutative_geometry", False, False, False, False, False, True),
    ("emergent_gravity", True, True, False, False, None, True),
)
# Connections known before, as (frameworks, topic, year, difficulty).
CONNECTIONS = (
    (("cdt",), "spectral_dimension", 2005, "easy"),
    (("asymptotic_safety",), "spectral_dimension", 2009, "easy"),
    (("horava_lifshitz",), "spectral_dimension", 2009, "easy"),
    (("cdt", "asymptotic_safety", "horava_lifshitz", "loop_quantum_gravity", "causal_sets"), "spectral_dimension", 2009, "easy"),
    (("string_theory",), "black_hole_entropy", 1996, "easy"),
    (("loop_quantum_gravity",), "black_hole_entropy", 1996, "medium"),
    (("loop_quantum_gravity", "string_theory", "asymptotic_safety"), "bh_entropy_log_correction", 2000, "medium"),
    (("string_theory", "loop_quantum_gravity", "asymptotic_safety"), "newton_correction", 1994, "medium"),
    (("string_theory", "emergent_gravity"), "other", 1997, "easy"),
    (("string_theory", "emergent_gravity"), "entanglement_entropy_area_law", 2006, "easy"),
    (("loop_quantum_gravity", "horava_lifshitz", "noncommutative_geometry", "string_theory"), "dispersion_relation_modification", 1998, "hard"),
    (("loop_quantum_gravity",), "area_gap", 1995, "easy"),
    (("asymptotic_safety",), "running_gravitational_coupling", 1998, "medium"),
    (("cdt", "asymptotic_safety", "horava_lifshitz", "loop_quantum_gravity", "causal_sets"), "spectral_dimension", 2017, "hard"),
)
# Turning points of physics and the words that tell of them.
TURNING_POINTS = (
    ("special relativity", ("drop", "absolute", "time", "simultaneity", "relativity", "lorentz", "frame", "observer", "invariant")),
    ("gauge/gravity duality", ("gauge", "gravity", "duality", "holographic", "ads", "cft", "boundary", "bulk", "correspondence", "maldacena")),
    ("singularities classified", ("singularity", "singularities", "classify", "classification", "topology", "ricci", "flow", "surgery", "obstacle", "feature")),
    ("information without meaning", ("information", "entropy", "abstract", "meaning", "communication", "channel", "capacity", "bit", "encoding", "drop", "semantic")),
    ("statistical mechanics", ("micro", "macro", "statistical", "thermodynamic", "ensemble", "counting", "states", "partition", "boltzmann", "emergent")),
    ("antimatter", ("negative", "energy", "antimatter", "positron", "dirac", "spinor", "relativistic", "obstacle", "prediction", "equation")),
    ("black hole radiation", ("hawking", "radiation", "black hole", "quantum", "semiclassical", "temperature", "combine", "unify", "information", "evaporation")),
    ("renormalizable gauge theories", ("renormalizab", "gauge", "non-abelian", "hooft", "renormalization", "yang-mills", "predictive", "ultraviolet", "finite", "divergence")),
    ("universality classes", ("renormalization group", "universality", "fixed point", "scaling", "critical", "wilson", "flow", "coarse", "effective", "irrelevant")),
    ("M-theory", ("unify", "unification", "string", "m-theory", "duality", "eleven", "dimension", "strong coupling", "witten", "membrane")),
    ("general relativity", ("geometry", "curvature", "metric", "geodesic", "equivalence principle", "spacetime", "einstein", "general relativity", "tensor")),
    ("conservation laws", ("symmetry", "conservation", "noether", "invariance", "charge", "continuous", "generator", "current")),
    ("entropy of horizons", ("entropy", "area", "horizon", "bekenstein", "proportional", "thermodynamic", "black hole", "holographic", "bound")),
    ("entropic force", ("entropic", "emergent", "thermodynamic", "temperature", "screen", "verlinde", "information", "holographic", "force")),
    ("field equations of state", ("thermodynamic", "einstein equation", "entropy", "horizon", "jacobson", "equilibrium", "clausius", "emergent", "derive")),
)
#: Premises that turned out wrong: (field, year, who, kind of error, kinds of symptoms, years stuck).
RECORDS = (
    ("planetary motion", 1543, "Copernicus", "MISIDENTIFIED_FUNDAMENTAL", ("EPICYCLE_ACCUMULATION", "UNEXPLAINED_COINCIDENCE"), 1400),
    ("planetary orbits", 1609, "Kepler", "UNNECESSARY_ASSUMPTION", ("EPICYCLE_ACCUMULATION", "UNEXPLAINED_VALUE"), 60),
    ("heat", 1798, "Rumford", "MISIDENTIFIED_FUNDAMENTAL", ("UNEXPLAINED_VALUE", "EPICYCLE_ACCUMULATION"), 80),
    ("combustion", 1777, "Lavoisier", "INVERTED_CAUSATION", ("EPICYCLE_ACCUMULATION", "UNEXPLAINED_VALUE"), 100),
    ("parallel lines", 1829, "Lobachevsky", "UNNECESSARY_ASSUMPTION", ("STRUCTURED_OBSTACLE", "NULL_RESULT"), 2000),
    ("equations of fifth degree", 1824, "Abel", "WRONG_LEVEL_OF_DESCRIPTION", ("STRUCTURED_OBSTACLE", "NULL_RESULT"), 250),
    ("species", 1859, "Darwin", "INVERTED_CAUSATION", ("UNEXPLAINED_COINCIDENCE", "EPICYCLE_ACCUMULATION"), 120),
    ("thermodynamics", 1877, "Boltzmann", "WRONG_LEVEL_OF_DESCRIPTION", ("DUAL_DESCRIPTION", "UNEXPLAINED_COINCIDENCE"), 30),
    ("radiation of black bodies", 1900, "Planck", "CONTINUITY_ASSUMPTION", ("UNEXPLAINED_VALUE", "STRUCTURED_OBSTACLE", "FRAMEWORK_MISMATCH"), 40),
    ("light and motion", 1905, "Einstein", "IMPLICIT_BACKGROUND", ("NULL_RESULT", "FRAMEWORK_MISMATCH", "UNEXPLAINED_COINCIDENCE"), 25),
    ("gravitation", 1915, "Einstein", "IMPLICIT_BACKGROUND", ("UNEXPLAINED_COINCIDENCE", "UNEXPLAINED_VALUE", "FRAMEWORK_MISMATCH"), 56),
    ("atoms", 1913, "Bohr", "WRONG_LEVEL_OF_DESCRIPTION", ("UNEXPLAINED_VALUE", "STRUCTURED_OBSTACLE"), 28),
    ("waves and particles", 1924, "de Broglie", "FALSE_DICHOTOMY", ("DUAL_DESCRIPTION", "FRAMEWORK_MISMATCH"), 20),
    ("foundations of arithmetic", 1931, "Goedel", "UNNECESSARY_ASSUMPTION", ("STRUCTURED_OBSTACLE", "PROLIFERATION_WITHOUT_SELECTION"), 30),
    ("communication", 1948, "Shannon", "MISIDENTIFIED_FUNDAMENTAL", ("UNIVERSAL_QUANTITY", "UNEXPLAINED_COINCIDENCE"), 20),
    ("drifting continents", 1912, "Wegener", "IMPLICIT_BACKGROUND", ("UNEXPLAINED_COINCIDENCE", "EPICYCLE_ACCUMULATION"), 60),
    ("parity", 1956, "Lee and Yang", "UNNECESSARY_ASSUMPTION", ("UNEXPLAINED_COINCIDENCE", "FRAMEWORK_MISMATCH"), 5),
    ("critical phenomena", 1971, "Wilson", "WRONG_LEVEL_OF_DESCRIPTION", ("UNIVERSAL_QUANTITY", "UNEXPLAINED_VALUE"), 40),
    ("entropy of black holes", 1973, "Bekenstein", "FALSE_DICHOTOMY", ("UNIVERSAL_QUANTITY", "FRAMEWORK_MISMATCH"), 10),
    ("strings", 1995, "Witten", "MISIDENTIFIED_FUNDAMENTAL", ("PROLIFERATION_WITHOUT_SELECTION", "DUAL_DESCRIPTION"), 10),
)
#: Problems still open, whose premises nobody has replaced: (field, year, kind of error suspected, kinds of symptoms, years stuck).
OPEN_PROBLEMS = (
    ("quantum gravity", 2025, "IMPLICIT_BACKGROUND", ("FRAMEWORK_MISMATCH", "PROLIFERATION_WITHOUT_SELECTION", "UNIVERSAL_QUANTITY", "UNEXPLAINED_VALUE"), 90),
    ("turbulence", 2025, "WRONG_LEVEL_OF_DESCRIPTION", ("UNEXPLAINED_VALUE", "EPICYCLE_ACCUMULATION"), 180),
    ("consciousness", 2025, "WRONG_LEVEL_OF_DESCRIPTION", ("FRAMEWORK_MISMATCH", "PROLIFERATION_WITHOUT_SELECTION"), 400),
    ("dark matter", 2025, "UNNECESSARY_ASSUMPTION", ("NULL_RESULT", "PROLIFERATION_WITHOUT_SELECTION"), 90),
    ("dark energy", 2025, "MISIDENTIFIED_FUNDAMENTAL", ("UNEXPLAINED_VALUE", "FRAMEWORK_MISMATCH"), 27),
)

RECORD = "field string, year int, person string, error string, symptoms array<string>, stuck int, succeeded boolean"


def frameworks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, n, list(c), p) for s, n, c, p in FRAMEWORKS], "slug string, name string, categories array<string>, expected int")


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TOPICS], "topic string")


def symmetries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SYMMETRIES), "slug string, diffeo boolean, lorentz boolean, foliation boolean, discrete boolean, super boolean, dual boolean")


def connections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, list(f), t, y, d) for i, (f, t, y, d) in enumerate(CONNECTIONS, 1)], "id int, frameworks array<string>, topic string, year int, difficulty string")


def turning_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, list(words)) for name, words in TURNING_POINTS], "name string, words array<string>")


def records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, y, w, e, list(s), n, True) for f, y, w, e, s, n in RECORDS], RECORD)


def open_problems(spark: SparkSession) -> DataFrame:
    """Records that did not succeed, for training beside those that did."""
    return spark.createDataFrame([(f, y, "unknown", e, list(s), n, False) for f, y, e, s, n in OPEN_PROBLEMS], RECORD)
