"""Default parameters.

Fixed values: the defaults of the published runs, stated together so that a
run with no arguments reproduces the same configuration.  (The marker phrase
lists and stop words are in ``functions/regex.py``; the threshold grid is in
``operators/sweep.py``.)
"""

SEED = 393
DISCOVERY_FRACTION = 0.25
TRAIN_FRACTION = 0.70
VALIDATION_FRACTION = 0.15
TEST_FRACTION = 0.15
PCA_DIMS = 50
UMAP_NEIGHBOURS = 15
UMAP_DIMS = 15
KMEANS_CLUSTERS = 16
EMBEDDING_WEIGHT = 0.35
BEHAVIOR_WEIGHT = 2.0
MIN_CLUSTER_SIZE = 50
SAMPLES_PER_CLUSTER = 5
SAMPLE_CHARS = 1200
TOP_TERMS = 10
OPENING_CHARS = 180
TOP_TAGS = 5
MAX_PREDICTED_TAGS = 5
DECISION_THRESHOLD = 0.0
PREVIEW_CHARS = 180
DISAGREEMENT_PREVIEW_CHARS = 300
CONFUSION_PAIRS = 50
