import sys

from siltstone.engine import main

sys.exit(main())
