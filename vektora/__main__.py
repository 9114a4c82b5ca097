from vektora.cli import main

main()
