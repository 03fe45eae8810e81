import sys

from lexforge.plans.build import main

sys.exit(main())
