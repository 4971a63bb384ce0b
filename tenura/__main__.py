import sys

from .plans.full_run import main

sys.exit(main())
