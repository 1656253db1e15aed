"""python -m logweave <log file> <output folder>"""

from logweave.plans.pipelines import main

raise SystemExit(main())
