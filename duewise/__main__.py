import sys

from duewise.plans.run import main

sys.exit(main())
