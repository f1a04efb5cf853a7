from larkspur.cli import main

raise SystemExit(main())
