"""Operating points. Every operator takes these as parameters; here are the defaults."""

# The operating points results depend on.
DEFAULT_THRESHOLD = 0.73
HARD_NEGATIVE_MARGIN = 0.02
MIN_AGREEMENTS = 5
PRODUCTION_THRESHOLD = 0.40
NORM_TOLERANCE = 1e-3
DUPLICATE_COSINE = 0.98
CLUSTER_RADIUS = 0.35
MIN_CLUSTER = 3
MAX_PROTOTYPES = 8
MIN_REFERENCES = 3
RELEVANCE_FLOOR = 0.4
CANDIDATE_LIMIT = 48
CAPTION_CHARS = 500
BOX_MARGIN_X, BOX_MARGIN_Y = 0.15, 0.2
BOX_SCALE_X, BOX_SCALE_Y = 1.2, 1.25
MIN_MEDIA_PX = 32
MERGE_IOU = 0.4
NMS_IOU = 0.3
DETECTION_SCORE = 0.5
STRIDES = (8, 16, 32)
TILE_GRID, TILE_OVERLAP, MIN_TILE_PX = 3, 0.25, 64
CROWD_FACES = 2
CHIP_SIZE = 112
TRACK_IOU = 0.3
TRACK_MAX_AGE_MS = 2000
TRACK_MISSES_LIBRARY, TRACK_MISSES_APP = 2, 4
ASSOCIATION_RADIUS_FACTOR, MIN_ASSOCIATION_RADIUS_PX = 1.5, 24
SAMPLE_IDLE_MS, SAMPLE_ACTIVE_MS = 800, 250
FAIL_STREAK = 3
MAX_TRACKED_VIDEOS = 8
QUEUE_WAIT_MS = 60_000
FRAME_MAX_WIDTH = 480
MAX_IMAGE_BYTES = 12 * 1024 * 1024
MAX_IMAGE_PIXELS = 12_000_000
MAX_BASE64_CHARS = -(-MAX_IMAGE_BYTES // 3) * 4

# Where Spark work changes shape. None of these changes a result; each large path has a
# registered query that must equal the small path's SQL.
BROADCAST_BYTES = 64 * 1024 * 1024   # largest gallery shipped to every executor
BLOCK_ROWS = 4096                    # rows of one side of a blocked vector task
FOLD_ROWS = 128                      # largest group compared as whole ranked rows
GROUP_ROWS = 4096                    # largest group handed to one grouped task
SCAN_ROWS = 2_000_000               # rows of one range of a running value
