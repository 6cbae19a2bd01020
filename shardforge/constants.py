"""Fixed values.

Values that must equal the reference's for the same results, stated once,
in the order the job uses them. Library defaults point here."""

import math

# Sampling job
LATENT_SHAPE = (4, 32, 32)        # C, H, W of one latent
LABEL_HIGH = 999                  # exclusive upper bound of the label draw
NULL_CLASS = 1000                 # class id of the unconditional (dropped) label
CLASS_DROPOUT = 0.1               # label dropout probability
NUM_STEPS_SHARD_JOB = 250         # solver steps, shard job
NUM_STEPS_PACK_JOB = 50           # solver steps, pack job
T_START = 1.0                     # time grid: linspace(T_START, T_END, n) then 0
T_END = 0.04
CFG_SCALE = 1.8                   # classifier-free guidance scale
GUIDANCE_LOW = 0.0                # guidance interval, closed at both ends
GUIDANCE_HIGH = 0.7
LATENT_SCALE = 0.18215            # latent / scale before the decoder
BATCH_PER_DEVICE = 64

# Shards and packs
ROWS_PER_SHARD = 8192
MAX_SHARD_BYTES = 3e10
KEEP_FILES_RUNNING = 3            # newest files held back while running
KEEP_FILES_FINAL = 0              # at the end everything ships
SHARD_NAME = "shards-%05d.tar"
SHARD_NAME_GZ = SHARD_NAME + ".gz"   # not the reference's: for records of short values
KEY_FORMAT = "%010d"
IMAGE_DIGITS = 6                  # {index:06d}.png

# features
MAX_PERIOD = 10000.0              # timestep features
SINCOS_TEMPERATURE = 10000.0      # position features
LAYER_NORM_EPS = 1e-6
GELU_TANH_C = 0.044715
QUICK_GELU_C = 1.702
BICUBIC_A = -0.75
LOGIT_SCALE_INIT = math.log(1 / 0.07)

# parity
PARITY_DECIMALS = 6               # per-part checks; 5 for the whole model
PARITY_FACTOR = 1.5               # |a - b| < 1.5 * 10^-decimals
