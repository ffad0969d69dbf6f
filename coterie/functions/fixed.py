"""Values that callers compare against, stated as they must appear."""

# --- fixed values: algorithm names -----------------------------------------
# Names written to the sweep ledger, in the order the sweep runs them.
KMEANS = "KMeans"
BISECTING = "BisectingKMeans"
MIXTURE = "GaussianMixture"

# Names shown to people and used in requests.
KMEANS_TITLE = "K-means"
MIXTURE_TITLE = "Gaussian mixture"
BISECTING_TITLE = "Bisecting K-Means"

# --- fixed values: sweep grid -----------------------------------------------
GRID_ROWS = [10, 25, 100, 500, 1000, 4000]
GRID_FEATURES = [3, 5, 10, 25]
GRID_CLUSTERS = [2, 3, 5]
GRID_MAX_ITERATIONS = [10, 25, 50]

# --- fixed values: sweep ledger columns --------------------------------------
LEDGER_KEYS = [
    "maxIteration",
    "Clusters",
    "Workers",
    "ByteSize",
    "RecordCount",
    "FeaturesCount",
]
JOB_SCHEMA = (
    "maxIteration int, Clusters int, Workers int, ByteSize bigint, RecordCount bigint, "
    "FeaturesCount int"
)
LEDGER_CSV_SCHEMA = JOB_SCHEMA + ", ExecutionSpeed double, Accuracy double, Algorithm string"
LEDGER_SCHEMA = LEDGER_CSV_SCHEMA + ", run_id string"

# --- fixed values: messages of the file check --------------------------------
FILE_TYPE = "Invalid file type"
FILE_EMPTY = "Empty file"
FILE_SHAPE = "Headers and values do not match at line "

# Our own message, for a path without a file.
FILE_MISSING = "File does not exist"

# --- fixed values: messages of the dataset label check -----------------------
LABEL_MISSING = "No label provided"
LABEL_SPACES = "Label cannot have spaces"
LABEL_CHARACTERS = "Label can only have letters and numbers"
LABEL_DIGIT = "Label cannot start with a number"
LABEL_TAKEN = "Label already exists"

# --- fixed values: messages of the clustering request check ------------------
REQUEST_DATASET = "Dataset Label does not exist"
REQUEST_CLUSTERS = "No number of clusters provided"
REQUEST_ALGORITHM = "No algorithm provided"
REQUEST_FEATURES = "At least two features are required"
REQUEST_LABEL_MISSING = "No clustering label provided"
REQUEST_LABEL_SPACES = "Clustering Label cannot have spaces"
REQUEST_LABEL_CHARACTERS = "Clustering Label can only have letters and numbers"
REQUEST_LABEL_DIGIT = "Clustering Label cannot start with a number"
REQUEST_LABEL_TAKEN = "Clustering label already exists"
REQUEST_MAX_ITERATIONS = "No maxIterations provided"
REQUEST_ALGORITHM_UNKNOWN = "Unknown algorithm"
REQUEST_ROWS = "Clusters amount cannot be more than the rows of the dataset"

# --- fixed values: run states and how the listing words them -----------------
RUNNING = "RUNNING"
SUBMITTED = "SUBMITTED"
FINISHED = "FINISHED"
FAILED = "FAILED"
UNKNOWN = "UNKNOWN"
LISTING_RUNNING = "The Job is still Running..."
LISTING_FAILED = "The Job Failed!"
LISTING_UNKNOWN = "Something went wrong!"

# --- fixed values: formats ----------------------------------------------------
TIMESTAMP_TEXT = "dd-MM-yyyy HH:mm:ss"
MIN_CLUSTERS = 2
MIN_MAX_ITERATIONS = 10
BYTES_PER_VALUE = 8
